"""Assets: images, fonts, stylesheets and scripts of pages, and how they match files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quiltlens.functions import markup as M
from quiltlens.operators.inventory import dedupe_first

# Query keys that ask a server to resize, and file endings.
RESIZE_KEYS = ["scale-down-to", "w", "width", "h", "height", "q", "quality", "fit", "dpr", "fm", "auto", "cs", "ixlib", "crop"]
IMAGE_END = r"(?i)\.(png|jpe?g|gif|webp|avif|svg)$"
RASTER_END = r"(?i)\.(png|jpe?g|gif|webp|avif)$"
FONT_END = r"(?i)\.(woff2?|ttf|otf|eot)$"
GENERIC_FAMILY = r"(?i)^\s*(system-ui|sans-serif|serif|monospace|ui-sans-serif|ui-serif|ui-monospace|emoji|cursive|fantasy|-apple-system|blinkmacsystemfont)\s*$"
LATIN_RANGE = r"(?i)U\+0*0+-0*00FF|U\+0*0+-0*007F|U\+0000-10FFFF"
WEIGHT_WORDS = {
    "thin": 100, "extralight": 200, "ultralight": 200, "light": 300, "regular": 400, "normal": 400, "book": 400, "medium": 500,
    "semibold": 600, "demibold": 600, "bold": 700, "extrabold": 800, "ultrabold": 800, "black": 900, "heavy": 900,
}


def original_url(url: Column) -> Column:
    """The address without resize parameters; wrapped image services give the inner address."""
    inner_next = F.try_url_decode(F.regexp_extract(url, r"/_next/image/?\?(?:[^#]*&)?url=([^&#]+)", 1))
    inner_cdn = F.try_url_decode(F.regexp_extract(url, r"/cdn-cgi/image/[^?#]*?(https?(?::|%3A).*)$", 1))
    raw = F.coalesce(F.nullif(inner_next, F.lit("")), F.nullif(inner_cdn, F.lit("")), url)
    base, query = F.regexp_replace(raw, r"[?#].*$", ""), F.regexp_extract(raw, r"\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.regexp_extract(p, "^([^=]*)", 1)).isin(*RESIZE_KEYS))
    return F.concat(base, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def file_name(url: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"([^/]+)$", 1)


def original_images(corpus: DataFrame) -> DataFrame:
    """One unscaled image address per file name and page, first seen wins."""
    found = M.all_matches(F.col("html"), r"""(?i)https?://[^"'()\s<>]+""")
    urls = corpus.select("site", "page_id", F.posexplode(F.transform(found, lambda u: original_url(F.regexp_replace(u, r"[.,;)]+$", "")))).alias("pos", "url"))
    images = urls.filter(F.regexp_replace("url", r"[?#].*$", "").rlike(IMAGE_END)).withColumn("name", file_name(F.col("url")))
    return dedupe_first(images, ["site", "page_id", "name"], ["pos"]).select("site", "page_id", F.col("pos").cast("bigint").alias("pos"), "name", "url")


def srcset_max_width(corpus: DataFrame) -> DataFrame:
    """Largest ``w`` descriptor per image name of a site."""
    sets = corpus.select("site", F.explode(M.all_matches(F.col("html"), r"""(?is)srcset\s*=\s*["']([^"']*)["']""", 1)).alias("s"))
    parts = sets.select("site", F.explode(F.split("s", ",")).alias("p")).withColumn("p", F.trim("p")).filter(F.col("p").rlike(r"^\S+\s+[0-9]+[wW]$"))
    return parts.select("site", file_name(original_url(F.regexp_extract("p", r"^(\S+)", 1))).alias("name"), F.regexp_extract("p", r"([0-9]+)[wW]$", 1).cast("bigint").alias("w")).groupBy("site", "name").agg(F.max("w").alias("max_width"))


def largest_original(files: DataFrame) -> DataFrame:
    """``files(site, name, path, bytes, width, height, sha256)``: the file with most pixels, then bytes, per name."""
    pixels = F.coalesce(F.col("width") * F.col("height"), F.lit(0)).cast("bigint")
    best = files.groupBy("site", "name").agg(F.max_by(F.struct("path", "sha256", "bytes", "width", "height"), F.struct(pixels, F.col("bytes"), F.col("path"))).alias("b"))
    return best.select("site", "name", "b.*")


def asset_ledger(planned: DataFrame, files: DataFrame) -> DataFrame:
    """``planned(site, url)`` against downloaded ``files``: kind, exact or missing, and the reason."""
    name = file_name(F.col("url"))
    kind = F.when(name.rlike(FONT_END), "font").when(name.rlike(r"(?i)\.svg$"), "svg").when(name.rlike(RASTER_END), "image").otherwise("other")
    p = planned.select("site", "url", name.alias("name"), kind.alias("kind")).distinct()
    j = p.join(largest_original(files), ["site", "name"], "left")
    reason = F.when(F.col("path").isNull(), "not downloaded").when(F.col("bytes") == 0, "empty file").otherwise("")
    return j.select("site", "url", "name", "kind", F.when(reason == "", "exact").otherwise("missing").alias("status"), reason.alias("reason"), "sha256", "bytes")


def asset_refs(corpus: DataFrame) -> DataFrame:
    """Every raster reference of a page in order: ``src``/``href`` attributes and ``url()`` values."""
    attr = M.all_matches(F.col("html"), r"""(?i)(?:src|href)\s*=\s*["']([^"']+)["']""", 1)
    css = M.all_matches(F.col("html"), r"""(?i)url\(\s*["']?([^"')]+)["']?\s*\)""", 1)
    refs = corpus.select("site", "page_id", F.posexplode(F.transform(F.concat(attr, css), lambda r: F.trim(r))).alias("pos", "ref"))  # F.trim itself would take the place as the characters to trim
    raster = F.regexp_replace("ref", r"[?#].*$", "").rlike(RASTER_END) | F.col("ref").rlike("^data:image/")
    return refs.filter(raster).withColumn("pos", F.col("pos").cast("bigint"))


def check_asset_refs(refs: DataFrame, files: DataFrame, originals: DataFrame) -> DataFrame:
    """Failing references: resized, remote, raster data URI, missing file, or bytes that are no source original.

    ``files(site, path, sha256)`` are the shipped files, ``originals(site, sha256)`` the ledger; a renamed copy passes.
    """
    bare = F.regexp_replace(F.regexp_replace("ref", r"[?#].*$", ""), r"^(\.{0,2}/)+", "")
    j = refs.withColumn("path", bare).join(files.select("site", "path", F.col("sha256").alias("_f")), ["site", "path"], "left")
    j = j.join(originals.select("site", F.col("sha256").alias("_f")).distinct().withColumn("_known", F.lit(True)), ["site", "_f"], "left")
    ref = F.col("ref")
    reason = (
        F.when(ref.startswith("data:image/"), F.when(~ref.startswith("data:image/svg"), "data uri")).when(ref.contains("scale-down-to="), "resized")
        .when(ref.rlike("^(https?:|//)"), "remote").when(F.col("_f").isNull(), "missing file").when(F.col("_known").isNull(), "not an original")
    )
    return j.withColumn("reason", reason).filter("reason IS NOT NULL").select("site", "page_id", "pos", "ref", "reason")


def _squeezed(svg: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(svg, r"\s+", " "), r">\s+<", "><")


def asset_census(corpus: DataFrame) -> DataFrame:
    """Inline drawings, images and backgrounds of a page, with a fingerprint and the words after each."""
    html = F.col("html")
    svg = F.transform(M.all_matches(html, r"(?is)<svg\b[^>]*>.*?</svg\s*>[^<]*"), lambda s: F.struct(
        F.lit("svg").alias("kind"), F.sha1(_squeezed(F.regexp_replace(s, r"(?is)(</svg\s*>)[^<]*$", "$1"))).alias("key"), M.squeeze(F.regexp_extract(s, r"(?is)</svg\s*>([^<]*)$", 1)).alias("near")))
    img = F.transform(M.all_matches(html, r"(?is)<img\b[^>]*>[^<]*"), lambda s: F.struct(F.lit("img").alias("kind"), M.basename(M.attr(s, "src")).alias("key"), M.squeeze(F.regexp_replace(s, r"(?s)^<[^>]*>", "")).alias("near")))
    back = F.transform(M.all_matches(html, r"""(?i)background(?:-image)?\s*:[^;"'}]*url\(\s*["']?([^"')]+)""", 1), lambda u: F.struct(F.lit("background").alias("kind"), M.basename(u).alias("key"), F.lit("").alias("near")))
    return corpus.select("site", "page_id", F.explode(F.concat(svg, img, back)).alias("a")).select("site", "page_id", "a.*").filter("key <> ''")


def missing_assets(source: DataFrame, built: DataFrame) -> DataFrame:
    """Census keys of the source that the built side lacks (file names compare without case)."""
    return source.select("site", "kind", "key").distinct().join(built.select("site", "kind", "key").distinct(), ["site", "kind", "key"], "left_anti")


FONT_FILE = r"(?i)^[^?#]*\.(?:woff2?|ttf|otf)(?:$|[?#])"  # fixed value: endings of font files


def font_faces(css: DataFrame) -> DataFrame:
    """``css(site, page, pos, css)`` → one row per ``@font-face`` that has a family and a font file."""
    faces = css.select("site", "page", "pos", F.posexplode(M.all_matches(F.col("css"), r"(?is)@font-face\s*\x7B([^\x7D]*)\x7D", 1)).alias("i", "f"))
    got = lambda prop: F.trim(F.regexp_replace(F.regexp_extract("f", rf"(?i)(?:^|[;\s]){prop}\s*:\s*([^;]+)", 1), "[\"']", ""))
    some = lambda c, d: F.when(c == "", d).otherwise(c)
    return faces.select(
        "site", "page", "pos", "i", got("font-family").alias("family"), some(got("font-weight"), "400").alias("weight"), some(got("font-style"), "normal").alias("style"),
        got("unicode-range").alias("unicode_range"), F.regexp_extract("f", r"""(?i)url\(\s*["']?([^"')\s]+)""", 1).alias("url"),
    ).filter((F.col("family") != "") & F.col("url").rlike(FONT_FILE))


def latin_faces(faces: DataFrame) -> DataFrame:
    """Faces with a Latin range or none, first of each full identity; families that differ in case only are two."""
    kept = faces.filter((F.trim("unicode_range") == "") | F.col("unicode_range").rlike(LATIN_RANGE))
    return dedupe_first(kept, ["site", "page", "family", "weight", "style", "unicode_range", "url"], ["pos", "i"])


def collect_plan_summary(pages: DataFrame, faces: DataFrame, kept: DataFrame, images: DataFrame) -> DataFrame:
    """Per page: title, faces, kept fonts, images, skipped faces."""
    count = lambda df, name: df.groupBy("site", "page").agg(F.count("*").alias(name))
    j = pages.join(count(faces, "faces"), ["site", "page"], "left").join(count(kept, "fonts"), ["site", "page"], "left").join(count(images, "images"), ["site", "page"], "left")
    j = j.na.fill(0, ["faces", "fonts", "images"])
    return j.withColumn("skipped", F.greatest(F.lit(0).cast("bigint"), F.col("faces") - F.col("fonts")))


def font_roster(library: DataFrame, css: DataFrame, files: DataFrame) -> DataFrame:
    """Non-generic families, library before stylesheet, first wins; weights read from file names.

    ``library(site, family, pos)``, ``css(site, family, pos)``, ``files(site, family, file)``.
    """
    both = library.select("site", "family", "pos", F.lit(0).alias("src")).unionByName(css.select("site", "family", "pos", F.lit(1).alias("src")))
    rows = both.filter(~F.col("family").rlike(GENERIC_FAMILY) & (F.trim("family") != "")).withColumn("key", F.lower(F.trim("family")))
    one = dedupe_first(rows, ["site", "key"], ["src", "pos"])
    name = F.lower("file")
    weight = F.coalesce(F.regexp_extract("file", r"[-_](\d00)\b", 1).try_cast("int"))
    for word, value in sorted(WEIGHT_WORDS.items(), key=lambda x: -len(x[0])):  # longer words hold shorter ones
        weight = F.coalesce(weight, F.when(name.contains(word), value))
    w = files.select("site", F.lower(F.trim("family")).alias("key"), F.coalesce(weight, F.lit(400)).cast("bigint").alias("weight")).distinct()
    return one.join(w, ["site", "key"], "left").select("site", "family", F.when(F.col("src") == 0, "library").otherwise("css").alias("origin"), "weight")


def font_face_check(built: DataFrame, source: DataFrame, files: DataFrame) -> DataFrame:
    """Built faces against source faces and shipped files: missing file, descriptor or byte mismatch, non-Latin subset.

    Faces are ``(site, family, weight, style, unicode_range, file, sha256)``.
    """
    key = F.concat_ws("|", F.lower("family"), "weight", F.lower("style"))
    s = source.groupBy("site", key.alias("key")).agg(F.min("sha256").alias("_sha"))
    known = source.groupBy("site", F.col("sha256")).agg(F.lit(True).alias("_bytes"))
    j = built.withColumn("key", key).join(s, ["site", "key"], "left").join(files.select("site", "file", F.lit(True).alias("_file")).distinct(), ["site", "file"], "left").join(known, ["site", "sha256"], "left")
    kinds = F.array_compact(F.array(
        F.when(F.col("_file").isNull(), "missing file"), F.when(F.col("_sha").isNull(), "descriptor mismatch"),
        F.when(F.col("_file").isNotNull() & F.col("_bytes").isNull(), "byte mismatch"),
        F.when((F.col("unicode_range") != "") & ~F.col("unicode_range").rlike(LATIN_RANGE), "non-latin subset"),
    ))
    return j.select("site", "family", "weight", "style", "file", F.explode(kinds).alias("kind"))


def element_inventory(corpus: DataFrame) -> DataFrame:
    """Images, forms with field counts and landmarks per section, page and site (nulls mark totals)."""
    html = M.visible(F.col("html"))
    sections = M.all_matches(html, r"(?is)<(?:header|section|footer)\b[^>]*>.*?</(?:header|section|footer)\s*>")
    rows = corpus.select("site", F.col("page_id").alias("page"), F.posexplode(sections).alias("section", "m"))
    count = lambda p: F.regexp_count("m", F.lit(p)).cast("bigint")
    facts = rows.select(
        "site", "page", F.col("section").cast("bigint").alias("section"), (count(r"(?i)<img\b") + count(r"(?i)background(?:-image)?\s*:[^;\"'}]*url\(")).alias("images"),
        count(r"(?i)<form\b").alias("forms"), count(r"(?i)<(?:input|textarea|select)\b").alias("fields"), count(r"(?i)<(?:header|nav|main|section|article|footer)\b").alias("landmarks"),
    )
    return facts.rollup("site", "page", "section").agg(*[F.sum(c).alias(c) for c in ("images", "forms", "fields", "landmarks")])


def html_inventory(corpus: DataFrame) -> DataFrame:
    """Counts of images, frames, headings, links and drawings, with flags for frames without source and date fields."""
    html = F.col("html")
    count = lambda p: F.regexp_count(html, F.lit(p)).cast("bigint")
    frames = M.all_matches(html, r"(?is)<iframe\b[^>]*>")
    return corpus.select(
        "site", "page_id", count(r"(?i)<img\b").alias("images"), count(r"(?i)<iframe\b").alias("frames"), count(r"(?i)<h[1-6]\b").alias("headings"), count(r"(?i)<a\b").alias("links"), count(r"(?i)<svg\b").alias("drawings"),
        F.exists(frames, lambda f: M.attr(f, "src") == "").alias("frame_without_source"), html.rlike(r"""(?i)<input\b[^>]*\btype\s*=\s*["']date""").alias("date_field"),
    )


def wiring_census(corpus: DataFrame) -> DataFrame:
    """Ordered, de-duplicated stylesheets and scripts per page; structured data is skipped.

    ``shared`` counts the sites that wire the same address.
    """
    html = F.regexp_replace(F.col("html"), r"(?s)<!--.*?-->", " ")
    split_at = F.locate("<body", F.lower(html))
    tags = r"""(?is)<link\b[^>]*\brel\s*=\s*["']?stylesheet[^>]*>|<script\b[^>]*>"""
    parts = F.array(
        F.struct(F.lit("head").alias("place"), M.all_matches(F.when(split_at > 0, F.substring(html, F.lit(1), split_at - 1)).otherwise(html), tags).alias("els")),
        F.struct(F.lit("body").alias("place"), M.all_matches(F.when(split_at > 0, F.substr(html, split_at)).otherwise(""), tags).alias("els")),
    )
    blocks = corpus.select("site", "page_id", F.posexplode(parts).alias("b", "p"))
    els = blocks.select("site", "page_id", "b", "p.place", F.posexplode("p.els").alias("i", "el"))
    el = F.col("el")
    script = M.tag_name(el) == "script"
    rows = els.select(
        "site", "page_id", "place", (F.col("b").cast("bigint") * F.lit(10_000_000_000) + F.col("i")).alias("pos"), F.when(script, "script").otherwise("style").alias("kind"),
        F.when(script, M.attr(el, "src")).otherwise(M.attr(el, "href")).alias("src"), M.has_attr(el, "defer").alias("deferred"), (F.lower(M.attr(el, "type")) == "module").alias("module"),
        F.lower(M.attr(el, "type")).contains("ld+json").alias("_data"),
    ).filter("NOT _data AND src <> ''").drop("_data").withColumn("external", F.col("src").rlike("^(https?:)?//"))
    one = dedupe_first(rows, ["page_id", "kind", "src"], ["pos"])
    shared = one.groupBy("kind", "src").agg(F.count_distinct("site").alias("shared"))
    return one.join(shared, ["kind", "src"])
