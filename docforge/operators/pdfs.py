"""What the object rows of PDF files (sources.pdf_objects) say: counts and active content, orphans, pages, annotations, attachments, images and where they are painted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from .components import _written, unreachable

#: Keys that name an attached file, the first present counts; keys of text that tells what an object is about.
FILE_NAMES = ("UF", "F", "Unix", "DOS")
TEXT_KEYS = ("Contents", "Text", "Value", "Desc", "Name", "Title", "Subject")


def latest(objects: DataFrame) -> DataFrame:
    """The rows in force: of an object that is defined several times, those of the last revision, and there of the last definition; trailers stay."""
    key = F.when(F.col("kind") == "inline", F.col("parent")).otherwise(F.col("obj"))
    top = F.max(F.struct("revision", "seq")).over(Window.partitionBy("doc_id", "_key"))
    keyed = objects.withColumn("_key", key).withColumn("_top", top)
    return keyed.filter(F.col("_key").isNull() | (F.col("seq") == F.col("_top.seq"))).drop("_key", "_top")


def in_force(objects: DataFrame, *columns: str) -> DataFrame:
    """latest with these columns, written once: what a plan meets several times would else be read from the files anew each time."""
    return _written(latest(objects).select("doc_id", *columns))


def _has(*keys: str) -> Column:
    return F.arrays_overlap("keys", F.array(*map(F.lit, keys)))


def _at(path: str) -> Column:
    return F.try_element_at("values", F.lit(path))


def _own() -> Column:
    """Whether a row is an object of its own, not a trailer or a part of another."""
    return F.col("kind").isin("dict", "stream", "array", "other", "broken")


def graph(objects: DataFrame) -> DataFrame:
    """A row for each file: how many objects, streams, object streams and revisions it has, and what it does of its own accord.

    doc_id, total_objects, total_streams, object_streams, revisions, embedded_files, javascript, launch, has_acroform, has_layers, open_action, additional_actions, has_annotations, broken.
    javascript and launch count objects that hold such an action or are one. Forms, layers and actions are looked for in the catalogue.
    """
    o = latest(objects)
    own, stream, catalog = _own(), F.col("kind") == "stream", F.col("type") == "Catalog"
    attached = (F.col("type") == "Filespec") | _has("EF", "EmbeddedFile")
    script = _has("JavaScript", "JS") | (_at("S") == "JavaScript")
    launch = _has("Launch") | (_at("S") == "Launch")
    page_notes = (F.col("type") == "Page") & _has("Annots")
    flag = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return o.groupBy("doc_id").agg(
        n(own).alias("total_objects"), n(stream).alias("total_streams"), n(stream & ((F.col("type") == "ObjStm") | (_has("First") & _has("N")))).alias("object_streams"),
        (F.max("revision") + 1).alias("revisions"), n(own & attached).alias("embedded_files"), n(script).alias("javascript"), n(launch).alias("launch"),
        flag(catalog & _has("AcroForm")).alias("has_acroform"), flag(catalog & _has("OCProperties")).alias("has_layers"), flag(catalog & _has("OpenAction")).alias("open_action"),
        flag(catalog & _has("AA")).alias("additional_actions"), flag(page_notes).alias("has_annotations"), n(F.col("kind") == "broken").alias("broken"),
    )


def links(objects: DataFrame) -> DataFrame:
    """doc_id, src, dst, path: the references of the objects in force."""
    return _links(latest(objects))


def _links(o: DataFrame) -> DataFrame:
    return o.filter(_own()).select("doc_id", F.col("obj").alias("src"), F.explode("refs").alias("r")).select("doc_id", "src", F.col("r.obj").alias("dst"), F.col("r.path").alias("path"))


def roots(objects: DataFrame) -> DataFrame:
    """doc_id, id: what the trailers, or streams that serve as such, call the root; a file without any begins at its catalogues."""
    return _roots(latest(objects))


def _roots(o: DataFrame) -> DataFrame:
    said = o.filter((F.col("kind") == "trailer") | (F.col("type") == "XRef")).select("doc_id", F.explode(F.filter("refs", lambda r: r["path"] == "Root")).alias("r")).select("doc_id", F.col("r.obj").alias("id")).distinct()
    catalogs = o.filter((F.col("type") == "Catalog") & _own()).select("doc_id", F.col("obj").alias("id"))
    return said.unionByName(catalogs.join(said, "doc_id", "left_anti"))


def orphans(objects: DataFrame) -> DataFrame:
    """doc_id, obj, kind, size, snippet: objects in force that no path leads to from the root. Object streams, cross-reference streams, and what a trailer names besides count as reached."""
    o = in_force(objects, "obj", "kind", "type", "refs", "values", "size", "text")
    named = o.filter((F.col("kind") == "trailer") | (F.col("type") == "XRef")).select("doc_id", F.explode("refs").alias("r")).select("doc_id", F.col("r.obj").alias("id"))
    start = _roots(o).unionByName(named).distinct()
    nodes = o.filter(_own() & ~F.coalesce(F.col("type").isin("ObjStm", "XRef"), F.lit(False))).select("doc_id", F.col("obj").alias("id"))
    lost = unreachable(nodes, _written(_links(o).select("doc_id", "src", "dst").distinct()), start, ["doc_id"])
    said = F.slice(F.filter(F.array(*(F.when(_at(k).isNotNull(), F.concat(F.lit(f"/{k}: "), F.substring(_at(k), 1, 80))) for k in TEXT_KEYS)), lambda x: x.isNotNull()), 1, 3)
    snippet = F.when(F.col("kind") == "stream", F.coalesce(F.substring("text", 1, 200), F.lit("[binary data]"))).when(F.size(said) > 0, F.substring(F.array_join(said, " | "), 1, 300))
    return o.filter(_own()).join(lost.withColumnRenamed("id", "obj"), ["doc_id", "obj"], "left_semi").select("doc_id", "obj", "kind", "size", snippet.alias("snippet"))


def _through(rows: DataFrame, objects: DataFrame, path: str) -> DataFrame:
    """rows (doc_id, ..., refs, values) with `under`: the references below `path`, whether it stands in the row or in an object that it refers to there."""
    inside = lambda r: r["path"].startswith(f"{path}.")
    rest = lambda refs, n: F.transform(refs, lambda r: F.struct(F.substring(r["path"], n + 2, 1000).alias("path"), r["obj"].alias("obj")))
    direct = F.filter("refs", inside)
    held = objects.filter(_own()).select("doc_id", F.col("obj").alias("_at"), F.col("refs").alias("_refs"))
    met = rows.withColumn("_direct", direct).withColumn("_at", F.try_element_at(F.filter("refs", lambda r: r["path"] == path), F.lit(1))["obj"])
    joined = met.join(held, ["doc_id", "_at"], "left")
    return joined.withColumn("under", F.concat(rest(F.col("_direct"), len(path)), F.coalesce("_refs", F.slice("_direct", 1, 0)))).drop("_direct", "_at", "_refs")


def pages(objects: DataFrame) -> DataFrame:
    """doc_id, page (from 1, in the order of the page tree), obj, media (four numbers), resources_of (the object whose Resources hold for it: its own or the next above).

    The tree is walked from the catalogue a level a round, all files at once; a page's place is the list of its places on the way. A node that is
    its own ancestor is passed over.
    """
    return _pages(in_force(objects, "obj", "kind", "type", "keys", "refs", "values"))


def _pages(o: DataFrame) -> DataFrame:
    own = o.filter(_own())
    kids = F.expr("transform(filter(refs, r -> r.path = 'Kids'), (r, i) -> struct(r.obj AS obj, i AS n))")
    nodes = own.select("doc_id", "obj", "type", kids.alias("kids"), _has("Resources").alias("has_resources"), _at("MediaBox").alias("media"))
    start = own.filter(F.col("type") == "Catalog").join(_roots(o).withColumnRenamed("id", "obj"), ["doc_id", "obj"], "left_semi")
    level = start.select("doc_id", F.explode(F.filter("refs", lambda r: r["path"] == "Pages")).alias("r")).select("doc_id", F.col("r.obj").alias("obj"), F.array().cast("array<int>").alias("place"), F.array().cast("array<int>").alias("way"), F.lit(None).cast("int").alias("resources_of"), F.lit(None).cast("string").alias("media_box"))
    found = None
    while True:
        met = level.join(nodes, ["doc_id", "obj"])
        met = met.withColumn("resources_of", F.when(F.col("has_resources"), F.col("obj")).otherwise(F.col("resources_of"))).withColumn("media_box", F.coalesce("media", "media_box"))
        met = _written(met.select("doc_id", "obj", "type", "place", F.concat("way", F.array("obj")).alias("way"), "kids", "resources_of", "media_box"))
        leaves = met.filter((F.col("type") == "Page") | (F.size("kids") == 0)).select("doc_id", "obj", "place", "resources_of", "media_box")
        found = leaves if found is None else found.unionByName(leaves)
        inner = met.filter((F.col("type").isNull() | (F.col("type") != "Page")) & (F.size("kids") > 0))
        level = inner.select("doc_id", "place", "way", "resources_of", "media_box", F.explode("kids").alias("k")).filter("not array_contains(way, k.obj)")
        level = level.select("doc_id", F.col("k.obj").alias("obj"), F.concat("place", F.array("k.n")).alias("place"), "way", "resources_of", "media_box")
        if not inner.limit(1).count():
            break
    media = F.transform(F.split("media_box", " "), lambda x: x.try_cast("double"))
    return found.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("place", "obj")).alias("page"), "obj", media.alias("media"), "resources_of")


def xobjects(objects: DataFrame, numbered: DataFrame | None = None) -> DataFrame:
    """doc_id, page, page_obj, name, obj: what each page's resources offer to be painted, wherever they are written."""
    o = in_force(objects, "obj", "kind", "type", "keys", "refs", "values")
    return _xobjects(o, _pages(o) if numbered is None else numbered)


def _xobjects(o: DataFrame, numbered: DataFrame) -> DataFrame:
    p = numbered.select("doc_id", "page", F.col("obj").alias("page_obj"), F.col("resources_of").alias("obj"))
    held = p.join(o.filter(_own()).select("doc_id", "obj", "refs"), ["doc_id", "obj"]).drop("obj")
    resources = _through(held, o, "Resources").select("doc_id", "page", "page_obj", F.col("under").alias("refs"))
    offered = _through(resources, o, "XObject").select("doc_id", "page", "page_obj", F.explode("under").alias("x"))
    return offered.select("doc_id", "page", "page_obj", F.col("x.path").alias("name"), F.col("x.obj").alias("obj"))


def images(objects: DataFrame, numbered: DataFrame | None = None) -> DataFrame:
    """doc_id, page, name, obj, width, height, size (bytes as stored), digest (MD5 of them): the images that each page's resources offer."""
    o = in_force(objects, "obj", "kind", "type", "subtype", "keys", "refs", "values", "size", "digest")
    return _images(o, _pages(o) if numbered is None else numbered)


def _images(o: DataFrame, numbered: DataFrame) -> DataFrame:
    whole = lambda k: _at(k).try_cast("int").alias(k.lower())
    found = o.filter((F.col("kind") == "stream") & (F.col("subtype") == "Image")).select("doc_id", "obj", whole("Width"), whole("Height"), "size", "digest")
    return _xobjects(o, numbered).join(found, ["doc_id", "obj"]).select("doc_id", "page", "name", "obj", "width", "height", "size", "digest")


def placements(objects: DataFrame) -> DataFrame:
    """images with box, and image_id by page: each time that a page's content paints one, where (from the top left, in points).

    The matrix in force maps the unit square; a page's content streams are taken one by one. Images painted within forms are not followed.
    """
    o = in_force(objects, "obj", "kind", "type", "subtype", "keys", "refs", "values", "size", "digest", "draws")
    numbered = _written(_pages(o))
    p = numbered.select("doc_id", "page", "obj", "media").join(o.filter(_own()).select("doc_id", "obj", "refs"), ["doc_id", "obj"])
    own = F.transform(F.filter("refs", lambda r: r["path"] == "Contents"), lambda r: r["obj"])
    at = p.select("doc_id", "page", "media", F.posexplode(own).alias("nth", "obj"))
    # /Contents may refer to an array of streams
    arrays = o.filter(F.col("kind") == "array").select("doc_id", "obj", F.transform("refs", lambda r: r["obj"]).alias("parts"))
    at = at.join(arrays, ["doc_id", "obj"], "left").select("doc_id", "page", "media", "nth", F.posexplode(F.coalesce("parts", F.array("obj"))).alias("part", "obj"))
    drawn = at.join(o.filter("kind = 'stream'").select("doc_id", "obj", "draws"), ["doc_id", "obj"]).select("doc_id", "page", "media", "nth", "part", F.posexplode("draws").alias("step", "d"))
    xs = lambda e, a, c: [F.col(f"d.{e}") + x for x in (F.lit(0.0), F.col(f"d.{a}"), F.col(f"d.{c}"), F.col(f"d.{a}") + F.col(f"d.{c}"))]
    x, y, top, left = xs("e", "a", "c"), xs("f", "b", "d"), F.coalesce(F.try_element_at("media", F.lit(4)), F.lit(792.0)), F.coalesce(F.try_element_at("media", F.lit(1)), F.lit(0.0))
    box = g.box(F.least(*x) - left, top - F.greatest(*y), F.greatest(*x) - left, top - F.least(*y))
    met = drawn.select("doc_id", "page", "nth", "part", "step", F.col("d.name").alias("name"), box.alias("box")).join(_images(o, numbered), ["doc_id", "page", "name"])
    nth = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("nth", "part", "step")) - 1
    return met.withColumn("_n", nth).select("doc_id", "page", F.format_string("p%d_i%d", "page", "_n").alias("image_id"), "name", "obj", "width", "height", "size", "digest", "box")


def annotations(objects: DataFrame, numbered: DataFrame | None = None) -> DataFrame:
    """doc_id, page, type, uri, content, field_name, rect: the notes, links and fields of each page, whether they are objects or stand in the page."""
    o = in_force(objects, "obj", "parent", "kind", "type", "keys", "refs", "values")
    p = (_pages(o) if numbered is None else numbered).select("doc_id", "page", "obj")
    held = p.join(o.filter(_own()).select("doc_id", "obj", "refs"), ["doc_id", "obj"])
    direct = held.select("doc_id", "page", F.explode(F.filter("refs", lambda r: r["path"] == "Annots")).alias("r")).select("doc_id", "page", F.col("r.obj").alias("obj"))
    arrays = o.filter(F.col("kind") == "array").select("doc_id", "obj", F.transform("refs", lambda r: r["obj"]).alias("parts"))
    of = direct.join(arrays, ["doc_id", "obj"], "left").select("doc_id", "page", F.explode(F.coalesce("parts", F.array("obj"))).alias("obj"))
    rows = of.join(o.filter(_own()).select("doc_id", "obj", "values"), ["doc_id", "obj"]).select("doc_id", "page", "values")
    inline = o.filter((F.col("kind") == "inline") & (_at("path") == "Annots")).select("doc_id", F.col("parent").alias("obj"), "values")
    both = rows.unionByName(p.join(inline, ["doc_id", "obj"]).select("doc_id", "page", "values")).filter(_at("Subtype").isNotNull())
    kind = _at("Subtype")
    return both.select(
        "doc_id", "page", kind.alias("type"), F.when(kind == "Link", _at("A.URI")).alias("uri"), F.when(kind == "Text", _at("Contents")).alias("content"),
        F.when(kind == "Widget", _at("T")).alias("field_name"), F.transform(F.split(_at("Rect"), " "), lambda v: v.try_cast("double")).alias("rect"),
    )


def attachments(objects: DataFrame) -> DataFrame:
    """doc_id, obj, name, file_obj, size: the files that a file carries, with the bytes of the stream that holds each."""
    o = in_force(objects, "obj", "kind", "type", "keys", "refs", "values", "size")
    spec = o.filter(_own() & ((F.col("type") == "Filespec") | _has("EF", "EmbeddedFile")))
    name = F.coalesce(*(_at(k) for k in FILE_NAMES), F.concat(F.lit("embedded_"), F.col("obj").cast("string")))
    file = F.try_element_at(F.filter("refs", lambda r: r["path"].isin("EF.F", "EF.UF")), F.lit(1))["obj"]
    streams = o.filter("kind = 'stream'").select("doc_id", F.col("obj").alias("file_obj"), "size")
    return spec.select("doc_id", "obj", name.alias("name"), file.alias("file_obj")).join(streams, ["doc_id", "file_obj"], "left").select("doc_id", "obj", "name", "file_obj", "size")
