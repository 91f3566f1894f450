"""Layout operators on blocks and elements, as native expressions, joins and windows keyed by document (and page).

Blocks: doc_id, page, ord, text, x, y, width, height, font_size, font_name, space_width, link_uri. Elements: doc_id, page,
ord, type, content, level, x, y, width, height, font_size, space_width, bold, last_y, link_uri. ord is reading order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import predicates as P
from ..functions.dialect import SPARK

PAGE = ("doc_id", "page")


def by_doc():
    return Window.partitionBy("doc_id").orderBy("page", "ord")


def by_page():
    return Window.partitionBy(*PAGE).orderBy("ord")


def exclusion_zone(blocks: DataFrame, page_height: float, top: float, bottom: float) -> DataFrame:
    """Without blocks whose baseline lies in the margins of that height; a margin of 0 is none. A column page_height of blocks tells each page's own."""
    own = F.col("page_height") if "page_height" in blocks.columns else F.lit(float(page_height))
    low = (F.col("y") < bottom) if bottom > 0 else F.lit(False)
    high = (own > 0) & (F.col("y") > own - top) if top > 0 else F.lit(False)
    return blocks.filter(~F.coalesce(low | high, F.lit(False))).drop("page_height")


def body_font_size(blocks: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, body: the size that most characters have; ties go to the smaller. 0 if no size is known."""
    per = blocks.withColumn("size", F.when(F.col("font_size") > 0, F.col("font_size"))).groupBy(*keys, "size").agg(F.sum(F.char_length("text")).alias("n"))
    return per.groupBy(*keys).agg(F.coalesce(F.min_by("size", F.when(F.col("size").isNotNull(), F.struct(-F.col("n"), "size"))), F.lit(0.0)).alias("body"))


def apply_links(blocks: DataFrame, links: DataFrame, share: float = DEFAULT.link_share) -> DataFrame:
    """blocks with link_uri: the first link (by link_ord) that covers over `share` of the block, or whose own area is covered so."""
    l = links.select(*(F.col(c).alias(f"l_{c}") for c in PAGE), "link_ord", F.col("uri").alias("l_uri"), F.least("x1", "x2").alias("lx1"), F.greatest("x1", "x2").alias("lx2"), F.least("y1", "y2").alias("ly1"), F.greatest("y1", "y2").alias("ly2"))
    w = F.least(F.col("x") + F.col("width"), "lx2") - F.greatest("x", "lx1")
    h = F.least(F.col("y") + F.col("height"), "ly2") - F.greatest("y", "ly1")
    area, own, other = w * h, F.col("width") * F.col("height"), (F.col("lx2") - F.col("lx1")) * (F.col("ly2") - F.col("ly1"))
    hit = (w > 0) & (h > 0) & ((other > 0) & (area / other > share) | (own > 0) & (area / own > share))
    both = blocks.select(*PAGE, "ord", "x", "y", "width", "height").join(l, (blocks["doc_id"] == F.col("l_doc_id")) & (blocks["page"] == F.col("l_page")) & hit)
    first = both.groupBy(*PAGE, "ord").agg(F.min_by("l_uri", "link_ord").alias("link_uri"))
    return blocks.drop("link_uri").join(first, [*PAGE, "ord"], "left")


def drop_figure_text(blocks: DataFrame, graphics: DataFrame, body: Column, min_size: float = DEFAULT.min_image_size) -> DataFrame:
    """Without small labels inside figures: graphics of at least min_size both ways that hold no block of nearly body size."""
    g = graphics.filter((F.col("width") >= min_size) & (F.col("height") >= min_size)).select(*(F.col(c).alias(f"g_{c}") for c in (*PAGE, "ord", "x", "y", "width", "height")))
    b = blocks.withColumn("_body", body)
    cx = F.col("x") + F.col("width") / 2
    inside = (b["doc_id"] == F.col("g_doc_id")) & (b["page"] == F.col("g_page")) & cx.between(F.col("g_x"), F.col("g_x") + F.col("g_width")) & F.col("y").between(F.col("g_y"), F.col("g_y") + F.col("g_height"))
    figures = g.join(b.filter(F.col("font_size") >= 0.9 * F.col("_body")), inside, "left_anti")
    inside = inside & (F.col("font_size") < 0.7 * F.col("_body"))
    return b.join(figures, inside, "left_anti").drop("_body")


def gutter(blocks: DataFrame, start: Column, end: Column, bins: int, size: float = 2.0) -> DataFrame:
    """doc_id, page, bin, density: the first window of `bins` bins that fewest blocks touch, within the page's extent."""
    b = blocks.select(*PAGE, start.alias("a"), end.alias("b"))
    b = b.withColumn("a0", F.min("a").over(Window.partitionBy(*PAGE)))
    b = b.select(*PAGE, F.floor((F.col("a") - F.col("a0")) / size).alias("s"), F.floor((F.col("b") - F.col("a0")) / size).alias("e"))
    # The histogram is a step function and a window's sum is linear between the places where either end of it meets a step,
    # so its first minimum is at one of these: some rows a block, however wide it is.
    steps = b.select(*PAGE, F.inline(F.array(F.struct(F.col("s").alias("bin"), F.lit(1).alias("d")), F.struct((F.col("e") + 1).alias("bin"), F.lit(-1).alias("d")))))
    near = F.array(*(F.struct((F.col("bin") + k).alias("bin"), (F.col("d") if k == 0 else F.lit(0)).alias("d")) for k in (-bins, 0, bins)))
    places = steps.groupBy(*PAGE, "bin").agg(F.sum("d").alias("d")).select(*PAGE, F.inline(near)).groupBy(*PAGE, "bin").agg(F.sum("d").alias("d"))
    w = Window.partitionBy(*PAGE).orderBy("bin")
    level = places.select(*PAGE, "bin", F.sum("d").over(w).alias("n"))
    area = level.select(*PAGE, "bin", F.coalesce(F.lag("n").over(w) * (F.col("bin") - F.lag("bin").over(w)), F.lit(0)).alias("area"))
    upto = area.select(*PAGE, "bin", F.sum("area").over(w).alias("upto"))
    win = upto.select(*PAGE, "bin", (F.max("upto").over(w.rangeBetween(bins, bins)) - F.col("upto")).alias("density"), F.max("bin").over(Window.partitionBy(*PAGE)).alias("top"))
    # inside the page's extent, whose end is `bins` below the last place; a place without another one at the window's end is none of the above
    win = win.filter((F.col("bin") >= 0) & (F.col("bin") <= F.col("top") - 2 * bins) & F.col("density").isNotNull())
    return win.groupBy(*PAGE).agg(F.min_by("bin", F.struct("density", "bin")).alias("bin"), F.min("density").alias("density"))


def as_elements(blocks: DataFrame) -> DataFrame:
    """Blocks as paragraph elements, with the marks of their fonts."""
    uri = F.col("link_uri") if "link_uri" in blocks.columns else F.lit(None).cast("string")
    return blocks.select(*PAGE, "ord", F.lit("paragraph").alias("type"), F.expr(P.styled(SPARK, "text", "font_name")).alias("content"), F.lit(0).alias("level"), "x", "y", "width", "height", "font_size", "space_width", F.lit(False).alias("bold"), F.lit(0.0).alias("last_y"), uri.alias("link_uri"))


#: name, condition on the trimmed text t, type. The first that holds decides; insert your own to extend.
Rule = tuple[str, Callable[[str], str], str]


def default_rules(config: Config = DEFAULT) -> list[Rule]:
    plain = lambda t: f"({P.unbolded(SPARK, t)})"
    return [
        ("admonition", lambda t: P.admonition(SPARK, t), "admonition"),
        ("code", lambda t: P.code_line(SPARK, t, "_free"), "code_block"),
        ("table", lambda t: P.table_row(SPARK, t, config.equation_score_threshold), "table"),
        ("numbered", lambda t: P.numbered_header(SPARK, "_plain"), "header"),
        ("lettered", lambda t: P.lettered_italic(SPARK, t), "header"),
        ("capitals", lambda t: P.caps_heading(SPARK, "_plain"), "header"),
        ("list", lambda t: P.list_item(SPARK, t), "list"),
    ]


def ratio_level(size: Column, body: Column, config: Config = DEFAULT) -> Column:
    out = F.lit(len(config.level_ratios) + 1)
    for level, ratio in reversed([*enumerate(config.level_ratios, 1)]):
        out = F.when(size / body >= ratio, level).otherwise(out)
    return out


def classify(elements: DataFrame, rules: list[Rule] | None = None, config: Config = DEFAULT) -> DataFrame:
    """elements (with body) with type, level, bold and content settled.

    Only "indented after a colon" looks at the element before; its level is its place in a run of such elements. So that
    rule is a lag and an island, the rest one CASE. Images are neither judged nor looked at.
    """
    rules = default_rules(config) if rules is None else rules
    e = elements.withColumn("_t", F.expr(SPARK.trim("content")))
    e = e.withColumn("_plain", F.expr(P.unbolded(SPARK, "_t"))).withColumn("_free", F.expr(SPARK.unmarked("_t")))
    judged = (F.col("type") != "image") & (F.col("_t") != "")
    big = F.col("font_size") > F.col("body") * config.header_size_ratio
    bare = F.regexp_replace("_t", r"^\*\*", "")
    continues = F.regexp_like(bare, F.lit(r"^[\s\p{Z}]*\p{Ll}")) | ~F.regexp_like(bare, F.lit(r"[\p{L}\p{Nd}]"))
    inner = F.trim(F.regexp_replace("_t", r"^\*\*|\*\*$", ""))
    short = F.startswith("_t", F.lit("**")) & F.endswith("_t", F.lit("**")) & F.octet_length(inner).between(3, 99) & ~F.regexp_like(inner, F.lit(r"^[0-9]|[.,;]$|\n"))
    rule = F.when(~judged, "none")
    for name, condition, _ in rules:
        rule = rule.when(F.expr(condition("_t")), name)
    e = e.withColumn("_rule", rule.when(big & continues, "ornament").when(big, "size").when(short, "bold").otherwise("plain"))
    types = F.when(F.col("_rule") == "none", F.col("type"))
    for name, _, kind in rules:
        types = types.when(F.col("_rule") == name, kind)
    types = types.when(F.col("_rule").isin("size", "bold"), "header").otherwise("paragraph")
    level = F.when(F.col("_rule") == "numbered", F.expr(P.numbered_level(SPARK, "_plain"))).when(F.col("_rule") == "size", ratio_level(F.col("font_size"), F.col("body"), config)).when(F.col("_rule") == "bold", 4).otherwise(F.col("level"))
    strips = F.col("_rule").isin("numbered", "capitals", "bold", "size")
    e = e.withColumn("_type", types).withColumn("level", level.cast("int"))
    e = e.withColumn("bold", F.when(strips, F.expr(P.fully_bold(SPARK, "_t"))).otherwise(F.col("bold"))).withColumn("content", F.when(strips, F.when(F.expr(P.fully_bold(SPARK, "content")), F.col("_plain")).when(F.col("_rule") == "size", F.col("content")).otherwise(F.col("_plain"))).otherwise(F.col("content")))
    # images keep their place but are skipped: the element before is the last that is none
    w = Window.partitionBy(*PAGE).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    prev = F.last(F.when(F.col("type") != "image", F.struct(F.expr(SPARK.trim("content")).alias("c"), "x")), ignorenulls=True).over(w)
    e = e.withColumn("_prev", prev)
    hit = (F.col("_rule") == "plain") & F.endswith(F.col("_prev.c"), F.lit(":")) & (F.col("x") > F.col("_prev.x") + config.indent)
    e = e.withColumn("_hit", F.coalesce(hit, F.lit(False)))
    other = F.when(~F.col("_hit") & (F.col("type") != "image"), 1).otherwise(0)
    e = e.withColumn("_island", F.sum(other).over(by_page()))
    nth = F.sum(F.col("_hit").cast("int")).over(Window.partitionBy(*PAGE, "_island").orderBy("ord"))
    e = e.withColumn("level", F.when(F.col("_hit"), nth.cast("int")).otherwise(F.col("level"))).withColumn("type", F.when(F.col("_hit"), "list").otherwise(F.col("_type")))
    return e.drop("_t", "_plain", "_free", "_rule", "_type", "_prev", "_hit", "_island")


def runs(df: DataFrame, fits: Column, joins: Column, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """df with _run (a number for each run of neighbours that fit and join the one before) and _n (its length; 0 if the row doesn't fit)."""
    order = Window.partitionBy(*keys).orderBy("ord") if "page" in keys else by_doc()
    d = df.withColumn("_fits", F.coalesce(fits, F.lit(False)))
    d = d.withColumn("_new", F.when(F.col("_fits") & F.coalesce(F.lag("_fits").over(order) & joins, F.lit(False)), 0).otherwise(1))
    d = d.withColumn("_run", F.sum("_new").over(order))
    return d.withColumn("_n", F.when(F.col("_fits"), F.count("*").over(Window.partitionBy(*keys, "_run"))).otherwise(0)).drop("_new", "_fits")


def demote_bold_runs(elements: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Bold headers of body size on consecutive lines are an emphasised paragraph."""
    fits = (F.col("type") == "header") & F.col("bold") & (F.col("font_size") <= F.col("body") * config.header_size_ratio)
    d = elements.withColumn("_depth", F.expr(P.numbering_depth(SPARK, f"({P.unbolded(SPARK, 'content')})")))
    before = lambda c: F.lag(c).over(by_page())
    joins = (F.col("_depth") == before("_depth")) & (F.abs(F.col("font_size") - before("font_size")) <= 0.5) & (F.abs(F.col("y") - before("y")) < 2 * before("font_size"))
    d = runs(d, fits, joins)
    many = F.col("_n") >= 2
    return d.withColumn("type", F.when(many, "paragraph").otherwise(F.col("type"))).withColumn("level", F.when(many, 0).otherwise(F.col("level"))).withColumn("content", F.when(many, F.concat(F.lit("**"), "content", F.lit("**"))).otherwise(F.col("content"))).drop("_run", "_n", "_depth")


def demote_numbered_runs(elements: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Numbered lines in body style one after another are a list; one that the next line continues is a paragraph."""
    fits = (F.col("type") == "header") & ~F.col("bold") & (F.col("font_size") <= F.col("body") * config.header_size_ratio) & F.expr(P.numbered_header(SPARK, "content"))
    d = elements.withColumn("_depth", F.expr(P.numbering_depth(SPARK, "content")))
    d = runs(d, fits, F.col("_depth") == F.lag("_depth").over(by_page()))
    after = lambda c: F.lead(c).over(by_page())
    goes_on = (after("type") == "paragraph") & F.regexp_like(F.regexp_replace(after("content"), r"^\*+", ""), F.lit(r"^\p{Ll}")) & (F.abs(after("y") - F.col("y")) < 2 * F.col("font_size"))
    many, one = F.col("_n") >= 2, (F.col("_n") == 1) & F.coalesce(goes_on, F.lit(False))
    d = d.withColumn("_one", one)
    return d.withColumn("type", F.when(many, "list").when(F.col("_one"), "paragraph").otherwise(F.col("type"))).withColumn("level", F.when(many, 1).when(F.col("_one"), 0).otherwise(F.col("level"))).drop("_run", "_n", "_depth", "_one")


def merge_runs(elements: DataFrame, kind: str, content: Column, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """Each run of elements of one type as its first, with the contents as lines and the heights added up."""
    d = runs(elements.withColumn("_line", content), F.col("type") == kind, F.lit(True), keys)
    d = d.withColumn("_group", F.when(F.col("_n") > 0, F.col("_run")).otherwise(F.lit(None)))
    w = Window.partitionBy(*keys, "_run").orderBy("page", "ord")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.row_number().over(w) == 1
    d = d.withColumn("_first", first).withColumn("content", F.when(F.col("_n") > 0, F.array_join(F.collect_list("_line").over(whole), "\n")).otherwise(F.col("content"))).withColumn("height", F.when(F.col("_n") > 0, F.sum("height").over(whole)).otherwise(F.col("height")))
    return d.filter(F.col("_first") | (F.col("_n") == 0)).drop("_line", "_run", "_n", "_group", "_first")


def merge_code_blocks(elements: DataFrame) -> DataFrame:
    return merge_runs(elements, "code_block", F.col("content"))


def merge_table_rows(elements: DataFrame) -> DataFrame:
    """Runs of table rows with pipes between columns; what has a single column is a paragraph again, or a header if numbered."""
    wide = F.replace("content", F.lit("    "), F.lit(" | "))
    head = F.coalesce(F.lag("type").over(by_page()) != "table", F.lit(True))
    row = F.concat(F.lit("| "), F.when(head, wide).otherwise(F.replace(wide, F.lit("   "), F.lit(" | "))), F.lit(" |"))
    d = merge_runs(elements, "table", row)
    single = (F.col("type") == "table") & ~F.exists(F.split("content", "\n"), lambda line: F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit(""))) > 2)
    bare = F.array_join(F.transform(F.split("content", "\n"), lambda line: F.regexp_replace(F.regexp_replace(F.trim(line), r"^\| ", ""), r" \|$", "")), "\n")
    d = d.withColumn("_single", single).withColumn("content", F.when(single, bare).otherwise(F.col("content")))
    numbered = F.col("_single") & F.expr(P.numbered_header(SPARK, "content"))
    return d.withColumn("level", F.when(numbered, 2).otherwise(F.col("level"))).withColumn("type", F.when(numbered, "header").when(F.col("_single"), "paragraph").otherwise(F.col("type"))).drop("_single")


def drop_page_numbers(elements: DataFrame) -> DataFrame:
    return elements.filter(~F.expr(P.page_number(SPARK, "content")))


def drop_running_headers(elements: DataFrame) -> DataFrame:
    """Without the top and bottom paragraphs of pages whose text, but for digits and blanks, recurs on a third of the pages and at least three."""
    w = Window.partitionBy(*PAGE)
    seen = (F.col("type") != "image") & (F.expr(SPARK.trim("content")) != "")
    d = elements.withColumn("_top", F.max_by("ord", F.when(seen, F.struct("y", -F.col("ord")))).over(w)).withColumn("_bottom", F.min_by("ord", F.when(seen, F.struct("y", "ord"))).over(w))
    d = d.withColumn("_edge", (F.col("ord") == F.col("_top")) | (F.col("ord") == F.col("_bottom"))).withColumn("_key", F.lower(F.regexp_replace("content", r"[\p{Nd}\s\p{Z}\x{85}]", "")))
    pages = elements.groupBy("doc_id").agg(F.count_distinct("page").alias("_pages"))
    keys = d.filter(F.col("_edge") & (F.col("_key") != "")).select("doc_id", "page", "_key").distinct().groupBy("doc_id", "_key").agg(F.count("*").alias("_c")).filter("_c >= 3").join(pages, "doc_id").filter("3 * _c >= _pages").select("doc_id", "_key", F.lit(True).alias("_often"))
    d = d.join(keys, ["doc_id", "_key"], "left")
    gone = F.coalesce(F.col("_often") & F.col("_edge") & (F.col("type") == "paragraph"), F.lit(False))
    return d.filter(~gone).select(*elements.columns)


def page_header_like(t: Column) -> Column:
    caps = (t == F.upper(t)) & F.octet_length(t).between(6, 59) & F.size(F.split(F.regexp_replace(t, r"[\s\p{Z}]+", " "), " ")).between(2, 8)
    return F.regexp_like(F.upper(t), F.lit("^(CHAPTER|SECTION|PART) ")) | caps


def drop_repeated_headers(elements: DataFrame) -> DataFrame:
    """Only the first of header-like texts that occur three times or more in a document."""
    t = F.expr(SPARK.trim("content"))
    d = elements.withColumn("_t", t)
    likely = (F.octet_length("_t") < 100) & (F.col("_t") != "") & page_header_like(F.col("_t"))
    w = Window.partitionBy("doc_id", "_t")
    d = d.withColumn("_n", F.count("*").over(w)).withColumn("_k", F.row_number().over(w.orderBy("page", "ord")))
    return d.filter(~(likely & (F.col("_n") >= 3) & (F.col("_k") > 1))).select(*elements.columns)


def rank_header_levels(elements: DataFrame) -> DataFrame:
    """Header levels from the document's header styles: by size, bold first, upright first, shallower numbering first; at most 6."""
    h = F.col("type") == "header"
    d = elements.withColumn("_size", F.round(2 * F.col("font_size")) / 2).withColumn("_italic", F.expr("content rlike '^[*][^*]+[*]$'")).withColumn("_depth", F.expr(P.numbering_depth(SPARK, "content")))
    base = ["doc_id", "type", "_size", "bold", "_italic"]
    d = d.withColumn("_least", F.min(F.when(F.col("_depth") > 0, F.col("_depth"))).over(Window.partitionBy(*base)))
    d = d.withColumn("_depth", F.when(F.col("_depth") == 0, F.coalesce("_least", F.lit(0))).otherwise(F.col("_depth")))
    rank = F.dense_rank().over(Window.partitionBy("doc_id", "type").orderBy(F.desc("_size"), F.desc("bold"), "_italic", "_depth"))
    return d.withColumn("level", F.when(h, F.least(rank, F.lit(6))).otherwise(F.col("level")).cast("int")).select(*elements.columns)


def remove_contents(elements: DataFrame) -> DataFrame:
    """Without the table of contents: from its title (or from the second element after an abstract) to the first chapter."""
    t = F.expr(SPARK.trim("content"))
    d = elements.withColumn("_i", F.row_number().over(by_doc())).withColumn("_t", F.lower(t))
    w = Window.partitionBy("doc_id")
    title = F.min(F.when(F.col("_t").isin("table of contents", "contents"), F.col("_i"))).over(w)
    abstract = F.min(F.when(F.col("_t") == "abstract", F.col("_i"))).over(w)
    d = d.withColumn("_title", title).withColumn("_abstract", abstract).withColumn("_from", F.coalesce("_title", F.col("_abstract") + 1))
    d = d.withColumn("_to", F.min(F.when(F.startswith("_t", F.lit("chapter 1")) & (F.col("_i") >= F.col("_from")), F.col("_i"))).over(w))
    # an abstract's own paragraph stays, unless it begins with a digit
    own = F.max(F.when((F.col("_i") == F.col("_from")) & (F.col("_from") < F.col("_to")) & (F.col("_from") == F.col("_abstract") + 1) & ~F.regexp_like("_t", F.lit("^[0-9]")), 1)).over(w)
    d = d.withColumn("_from", F.col("_from") + F.coalesce(own, F.lit(0)))
    return d.filter(F.col("_to").isNull() | (F.col("_i") < F.col("_from")) | (F.col("_i") >= F.col("_to"))).select(*elements.columns)


SOFT = "­"
BROKEN = rf"\p{{L}}+(?:{SOFT}\p{{L}}+)+"


def resolve_word_breaks(elements: DataFrame) -> DataFrame:
    """Words with soft hyphens lose them if the document also has the word whole, and else get hyphens."""
    pieces = F.regexp_extract_all("content", F.lit(BROKEN), F.lit(0))
    broken = elements.filter(F.contains("content", F.lit(SOFT)))
    wanted = broken.select("doc_id", F.explode(F.array_distinct(pieces)).alias("w")).distinct().withColumn("low", F.lower(F.replace("w", F.lit(SOFT), F.lit(""))))
    # only documents with breaks are tokenised
    known = elements.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("content"), F.lit(r"\p{L}+"), F.lit(0)))).alias("low")).distinct()
    whole = wanted.join(known, ["doc_id", "low"], "left_semi").groupBy("doc_id").agg(F.collect_list("w").alias("_whole"))
    d = elements.join(whole, "doc_id", "left")
    # cut at each broken word, settle it, and put the text together again
    fixed = F.transform(pieces, lambda p: F.when(F.array_contains(F.coalesce("_whole", F.array().cast("array<string>")), p), F.replace(p, F.lit(SOFT), F.lit(""))).otherwise(F.replace(p, F.lit(SOFT), F.lit("-"))))
    gaps = F.split("content", BROKEN)
    content = F.array_join(F.flatten(F.zip_with(gaps, fixed, lambda g, f: F.array(g, F.coalesce(f, F.lit(""))))), "")
    return d.withColumn("content", F.when(F.contains("content", F.lit(SOFT)), content).otherwise(F.col("content"))).select(*elements.columns)


def best_detections(elements: DataFrame, detections: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """elements with class_id and class_conf of the detection that overlaps most (over match_iou; the first among equals), and the type it asks for."""
    from ..functions.boxes import CLASS_TYPES, iou

    d = detections.select(*(F.col(c).alias(f"d_{c}") for c in (*PAGE, "ord", "x1", "y1", "x2", "y2", "confidence", "class_id")))
    e = elements.select(*PAGE, "ord", "x", "y", "width", "height")
    near = (e["doc_id"] == F.col("d_doc_id")) & (e["page"] == F.col("d_page")) & (F.col("d_x1") < F.col("x") + F.col("width")) & (F.col("d_x2") > F.col("x")) & (F.col("d_y1") < F.col("y") + F.col("height")) & (F.col("d_y2") > F.col("y"))
    both = e.join(d, near).withColumn("v", iou(F.col("x"), F.col("y"), F.col("x") + F.col("width"), F.col("y") + F.col("height"), *(F.col(f"d_{c}") for c in ("x1", "y1", "x2", "y2")))).filter(F.col("v") > config.match_iou)
    best = both.groupBy(*PAGE, "ord").agg(F.max_by(F.struct("d_class_id", "d_confidence"), F.struct("v", -F.col("d_ord"))).alias("m"))
    out = elements.join(best, [*PAGE, "ord"], "left").withColumn("class_id", F.col("m.d_class_id")).withColumn("class_conf", F.col("m.d_confidence")).drop("m")
    named = F.create_map(*(x for k, v in CLASS_TYPES.items() for x in (F.lit(k), F.lit(v))))[F.col("class_id")]
    return out.withColumn("type", F.when((F.col("type") != "image") & (F.col("class_conf") >= config.override_confidence) & named.isNotNull() & (named != ""), named).otherwise(F.col("type")))


def link_elements(elements: DataFrame, links: DataFrame, share: float = DEFAULT.link_share) -> DataFrame:
    """Paragraphs, headers and lists that a link covers, as [content](uri)."""
    linked = apply_links(elements.withColumn("_old", F.col("link_uri")), links, share)
    wraps = F.col("type").isin("paragraph", "header", "list") & F.col("link_uri").isNotNull()
    out = linked.withColumn("content", F.when(wraps, F.concat(F.lit("["), "content", F.lit("]("), "link_uri", F.lit(")"))).otherwise(F.col("content")))
    return out.withColumn("link_uri", F.coalesce("link_uri", "_old")).select(*elements.columns)


def confident(detections: DataFrame, least: float = DEFAULT.detection_confidence, class_id: int | None = None) -> DataFrame:
    """Detections of at least that confidence, and of one class if it is named."""
    kept = detections.filter(F.col("confidence") >= least)
    return kept if class_id is None else kept.filter(F.col("class_id") == class_id)


def by_confidence(detections: DataFrame) -> DataFrame:
    """detections with nth: their place on the page (from 1), the surest first."""
    return detections.withColumn("nth", F.row_number().over(Window.partitionBy(*PAGE).orderBy(F.desc("confidence"), "ord")))


def by_position(detections: DataFrame) -> DataFrame:
    """detections with nth: their place on the page (from 1) by top, then left edge."""
    return detections.withColumn("nth", F.row_number().over(Window.partitionBy(*PAGE).orderBy("y1", "x1", "ord")))


def as_pictures(extra: DataFrame, least: float, after: int) -> DataFrame:
    """Images or drawings as elements: those that were saved and are large enough both ways, placed after the page's text."""
    kept = extra.filter((F.col("id") != "") & (F.col("width") >= least) & (F.col("height") >= least))
    return kept.select(*PAGE, (F.col("ord") + after).cast("int").alias("ord"), F.lit("image").alias("type"), F.col("id").alias("content"), F.lit(0).alias("level"), "x", "y", "width", "height", F.lit(0.0).alias("font_size"), F.lit(0.0).alias("space_width"), F.lit(False).alias("bold"), F.lit(0.0).alias("last_y"), F.lit(None).cast("string").alias("link_uri"))


def fuse_detections(elements: DataFrame, detections: DataFrame | None, config: Config = DEFAULT) -> DataFrame:
    """Rule-based elements, corrected by a layout model's detections where there are any; without them as they are."""
    if detections is None:
        return elements
    return best_detections(elements, confident(detections, config.detection_confidence), config).drop("class_id", "class_conf")
