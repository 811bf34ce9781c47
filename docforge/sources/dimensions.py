"""Small tables: rates by law, fingerprints of producers, risks. Their rows are fixed values, written here in natural order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: key, role, rate, tolerance, effective_from
STATUTORY = [
    ("epf", "employee", "0.11", "0.005", "2023-01-01"), ("epf", "employer", "0.13", "0.005", "2023-01-01"),
    ("socso", "employee", "0.005", "0.002", "2023-01-01"), ("socso", "employer", "0.0175", "0.002", "2023-01-01"),
    ("eis", "employee", "0.002", "0.001", "2023-01-01"), ("eis", "employer", "0.002", "0.001", "2023-01-01"),
]
#: Producer, category, risk at first sight, and its profile of risks by type of document (RISK_PROFILES).
PRODUCERS = [
    ("microsoft_word", "office", "low", "writing"),
    ("libreoffice", "office", "low", "writing"),
    ("adobe_acrobat", "pdf_editor", "low", "harmless"),
    ("adobe_photoshop", "image_editor", "high", "image_editing"),
    ("adobe_indesign", "desktop_publishing", "medium", "publishing"),
    ("canva", "online_design", "high", "online"),
    ("macos_quartz", "os_system", "low", "printing"),
    ("microsoft_print_to_pdf", "os_system", "low", "printing"),
    ("pdfium", "os_system", "low", "printing"),
    ("ghostscript", "conversion_engine", "medium", "conversion"),
    ("skia_pdf", "conversion_engine", "medium", "browser"),
    ("pdftex", "tex", "low", "typesetting"),
    ("luatex", "tex", "low", "typesetting"),
    ("itext", "pdf_library", "medium", "conversion"),
    ("reportlab", "pdf_library", "high", "programmed"),
    ("fpdf", "pdf_library", "high", "programmed"),
    ("pdf24", "online_converter", "high", "online"),
    ("pdf2go", "online_converter", "high", "online"),
    ("chatgpt_pdf", "ai_generator", "critical", "generated"),
    ("adobe_photoshop_image", "image_editor", "medium", None),
    ("adobe_lightroom", "image_editor", "low", None),
    ("gimp", "image_editor", "medium", None),
    ("iphone_camera", "camera", "low", None),
    ("android_camera", "camera", "low", None),
    ("canon_camera", "camera", "low", None),
    ("sony_camera", "camera", "low", None),
    ("canva_image", "image_editor", "medium", None),
]
#: Producer, field, pattern, weight. Text fields are matched without punctuation, header_binary and pdf_version as they are.
FINGERPRINTS = [
    ("microsoft_word", "creator", r"(?i)Microsoft\s*Word", 1.0),
    ("microsoft_word", "producer", r"(?i)Microsoft\s*(?:Print\s*To\s*PDF|Word)", 0.9),
    ("microsoft_word", "creator_tool", r"(?i)Microsoft\s*Word", 1.0),
    ("microsoft_word", "header_binary", r"\xB5\xB5\xB5\xB5", 0.95),
    ("microsoft_word", "structure", r"trailer.*/Info.*/ID.*/Prev", 0.7),
    ("libreoffice", "creator", r"(?i)LibreOffice", 1.0),
    ("libreoffice", "producer", r"(?i)LibreOffice", 1.0),
    ("libreoffice", "creator_tool", r"(?i)LibreOffice", 1.0),
    ("adobe_acrobat", "producer", r"(?i)Adobe\s*Acrobat", 1.0),
    ("adobe_acrobat", "creator_tool", r"(?i)Adobe\s*Acrobat", 0.8),
    ("adobe_acrobat", "header_binary", r"\xE2\xE3\xCF\xD3", 0.95),
    ("adobe_photoshop", "producer", r"(?i)Adobe\s*Photoshop", 1.0),
    ("adobe_photoshop", "creator", r"(?i)Adobe\s*Photoshop", 0.9),
    ("adobe_photoshop", "creator_tool", r"(?i)Adobe\s*Photoshop", 0.9),
    ("adobe_photoshop", "header_binary", r"\xE2\xE3\xCF\xD3", 0.3),
    ("adobe_indesign", "producer", r"(?i)Adobe\s*InDesign", 1.0),
    ("adobe_indesign", "creator", r"(?i)Adobe\s*InDesign", 0.9),
    ("canva", "producer", r"(?i)Canva", 1.0),
    ("canva", "creator", r"(?i)Canva", 0.7),
    ("canva", "pdf_version", r"1.4", 0.6),
    ("macos_quartz", "producer", r"(?i)Quartz\s*PDFContext", 1.0),
    ("macos_quartz", "creator", r"(?i)Quartz", 0.7),
    ("macos_quartz", "header_binary", r"\x00\x00\x00\x00", 0.5),
    ("microsoft_print_to_pdf", "producer", r"(?i)Microsoft\s*:?\s*Print\s*To\s*PDF", 1.0),
    ("pdfium", "producer", r"(?i)PDFium", 1.0),
    ("ghostscript", "producer", r"(?i)GPL\s*Ghostscript", 1.0),
    ("ghostscript", "producer", r"(?i)Ghostscript", 0.9),
    ("ghostscript", "header_binary", r"\x00\x00\x00\x00", 0.4),
    ("skia_pdf", "producer", r"(?i)Skia/PDF\s*m\d+", 1.0),
    ("pdftex", "producer", r"(?i)pdf[eE]?TeX", 1.0),
    ("pdftex", "header_binary", r"\xD0\xD4\xC5\xD8", 0.8),
    ("luatex", "producer", r"(?i)LuaTeX", 1.0),
    ("luatex", "header_binary", r"\xD0\xD4\xC5\xD8", 0.6),
    ("itext", "producer", r"(?i)iText", 1.0),
    ("reportlab", "producer", r"(?i)ReportLab", 1.0),
    ("reportlab", "creator", r"(?i)ReportLab", 0.9),
    ("fpdf", "producer", r"(?i)FPDF", 1.0),
    ("fpdf", "creator", r"(?i)FPDF", 0.9),
    ("pdf24", "producer", r"(?i)PDF24", 1.0),
    ("pdf24", "creator", r"(?i)PDF24", 0.8),
    ("pdf2go", "producer", r"(?i)pdf2go", 1.0),
    ("pdf2go", "creator", r"(?i)pdf2go", 0.8),
    ("chatgpt_pdf", "producer", r"(?i)ChatGPT", 1.0),
    ("chatgpt_pdf", "creator", r"(?i)ChatGPT", 0.9),
    ("adobe_photoshop_image", "software", r"(?i)Adobe\s*Photoshop", 1.0),
    ("adobe_photoshop_image", "creator_tool", r"(?i)Adobe\s*Photoshop", 0.9),
    ("adobe_photoshop_image", "creator", r"(?i)Adobe\s*Photoshop", 0.8),
    ("adobe_lightroom", "software", r"(?i)Adobe\s*Lightroom", 1.0),
    ("adobe_lightroom", "creator_tool", r"(?i)Adobe\s*Lightroom", 0.9),
    ("gimp", "software", r"(?i)GIMP", 1.0),
    ("gimp", "creator_tool", r"(?i)GIMP", 0.9),
    ("iphone_camera", "make", r"(?i)Apple", 1.0),
    ("iphone_camera", "model", r"(?i)iPhone", 1.0),
    ("iphone_camera", "software", r"(?i)iOS|iPhone", 0.7),
    ("android_camera", "make", r"(?i)Samsung|Google|OnePlus|Xiaomi|Huawei|Oppo|Vivo", 0.9),
    ("android_camera", "model", r"(?i)SM-|Pixel|NE221|M2007", 0.8),
    ("canon_camera", "make", r"(?i)Canon", 1.0),
    ("canon_camera", "model", r"(?i)EOS|PowerShot|IXUS", 0.9),
    ("sony_camera", "make", r"(?i)Sony", 1.0),
    ("sony_camera", "model", r"(?i)ILCE|DSC|HDR", 0.9),
    ("canva_image", "software", r"(?i)Canva", 1.0),
    ("canva_image", "creator_tool", r"(?i)Canva", 0.8),
]
#: Types of document that have a risk, and each profile's risk in their order.
RISK_TYPES = ["invoice", "bank_statement", "legal_document", "contract", "certificate", "resume", "summons", "tax_document", "receipt", "quotation", "purchase_order", "payslip"]
RISK_PROFILES = {
    "writing": ["low", "medium", "low", "low", "low", "low", "medium", "medium", "low", "low", "low", "medium"],
    "typesetting": ["low", "medium", "low", "low", "low", "low", "medium", "medium", "medium", "low", "low", "medium"],
    "harmless": ["low"] * 12,
    "image_editing": ["high", "critical", "high", "high", "high", "low", "critical", "critical", "high", "medium", "medium", "critical"],
    "publishing": ["medium", "high", "medium", "medium", "low", "low", "high", "high", "medium", "medium", "medium", "high"],
    "online": ["high", "critical", "high", "high", "high", "medium", "critical", "critical", "high", "high", "high", "critical"],
    "printing": ["low", "low", "low", "low", "low", "low", "medium", "medium", "low", "low", "low", "low"],
    "conversion": ["medium", "high", "medium", "medium", "medium", "low", "high", "high", "medium", "medium", "medium", "high"],
    "browser": ["medium", "medium", "medium", "medium", "medium", "low", "high", "high", "medium", "medium", "medium", "medium"],
    "programmed": ["critical", "critical", "critical", "critical", "critical", "medium", "critical", "critical", "critical", "critical", "critical", "critical"],
    "generated": ["critical", "critical", "critical", "critical", "critical", "high", "critical", "critical", "critical", "critical", "critical", "critical"],
}
#: Producers of images, type of document, risk.
IMAGE_RISKS = [
    ("adobe_photoshop_image", "photograph", "low"),
    ("adobe_photoshop_image", "official_document", "critical"),
    ("adobe_photoshop_image", "id_card", "critical"),
    ("adobe_lightroom", "photograph", "low"),
    ("adobe_lightroom", "official_document", "high"),
    ("gimp", "photograph", "low"),
    ("gimp", "official_document", "high"),
    ("iphone_camera", "photograph", "low"),
    ("iphone_camera", "official_document", "medium"),
    ("iphone_camera", "id_card", "medium"),
    ("android_camera", "photograph", "low"),
    ("android_camera", "official_document", "medium"),
    ("android_camera", "id_card", "medium"),
    ("canon_camera", "photograph", "low"),
    ("canon_camera", "official_document", "medium"),
    ("sony_camera", "photograph", "low"),
    ("sony_camera", "official_document", "medium"),
    ("canva_image", "photograph", "low"),
    ("canva_image", "official_document", "critical"),
    ("canva_image", "id_card", "critical"),
]
#: Categories of tools and the names that tell them, in the order in which they are looked for.
TOOL_WORDS = {
    "office_suite": [
        "microsoft word", "microsoft excel", "microsoft powerpoint", "microsoft office", "libreoffice", "openoffice", "writer", "calc", "impress",
        "wps office", "wps writer", "wps spreadsheet", "pages", "numbers", "keynote", "google docs", "google sheets", "google slides",
        "wordperfect", "quattro pro", "onlyoffice", "zoho writer",
    ],
    "image_editor": [
        "adobe photoshop", "photoshop", "ps", "canva", "gimp", "gnu image manipulation", "photopea", "pixlr", "krita", "procreate",
        "affinity photo", "affinity designer", "coreldraw", "corel photopaint", "paint.net", "paint shop pro", "sketch", "figma",
        "adobe illustrator", "illustrator", "ai", "inkscape",
    ],
    "pdf_editor": [
        "adobe acrobat", "acrobat", "foxit pdf", "foxit phantompdf", "pdf-xchange", "pdf-xchange editor", "nitro pdf", "nitro pro",
        "pdfelement", "wondershare pdfelement", "sejda", "pdf escape", "abbyy finereader", "abbyy pdf",
    ],
    "scan_capture": [
        "adobe scan", "adobe scanner", "camscanner", "microsoft lens", "office lens", "abbyy", "tesseract", "scanner", "scanning",
        "genius scan", "scanner pro", "clear scanner", "pdf scanner", "photocopier", "canon", "brother", "epson",
    ],
    "online_converter": [
        "ilovepdf", "smallpdf", "pdf24", "pdf2go", "pdfcandy", "online-convert", "cloudconvert", "hipdf", "easypdf", "deftpdf", "pdfonline", "convertio",
    ],
    "pdf_library": [
        "reportlab", "fpdf", "pyfpdf", "pypdf", "pypdf2", "pikepdf", "pymupdf", "fitz", "cairo", "pango", "skia", "chromium pdf",
        "itext", "itextsharp", "pdfbox", "apache pdfbox", "tcpdf", "dompdf", "wkhtmltopdf", "weasyprint", "xhtml2pdf", "pdfkit",
        "prawn", "hexapdf", "libharu", "hpdf",
    ],
    "os_print_system": [
        "microsoft print to pdf", "windows print", "windows pdf", "quartz pdfcontext", "macos quartz", "mac pdf", "cups", "cups-pdf",
        "chromium print", "google chrome print", "edge print", "firefox print",
    ],
    "tex_ecosystem": ["pdftex", "pdflatex", "luatex", "lualatex", "xetex", "xelatex", "tex", "latex"],
}
#: Part of a tool's name and its category: the first that is found counts.
TOOL_CATEGORIES = [(word, category) for category, words in TOOL_WORDS.items() for word in words]


def statutory(spark: SparkSession) -> DataFrame:
    t = spark.createDataFrame(STATUTORY, "key string, role string, rate string, tolerance string, effective_from string")
    return t.selectExpr("key", "role", "CAST(rate AS DECIMAL(18,6)) AS rate", "CAST(tolerance AS DECIMAL(18,6)) AS tolerance", "CAST(effective_from AS DATE) AS effective_from")


def fingerprints(spark: SparkSession) -> DataFrame:
    category = {name: category for name, category, *_ in PRODUCERS}
    rows = [(p, category[p], field, pattern, weight) for p, field, pattern, weight in FINGERPRINTS]
    return spark.createDataFrame(rows, "producer string, category string, field string, pattern string, weight double")


def risks(spark: SparkSession) -> DataFrame:
    rows = [(p, kind, level) for p, _, _, profile in PRODUCERS if profile for kind, level in zip(RISK_TYPES, RISK_PROFILES[profile])]
    return spark.createDataFrame(rows + IMAGE_RISKS, "producer string, document_type string, level string")
