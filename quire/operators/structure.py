"""Structure found across the lines and pages of a book: headers, chapters, split formulas, references, tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import latex as L
from quire.functions import lines as P
from quire.functions import text as T
from quire.operators.blocks import BLOCK_WIDTH, with_running
from quire.operators.glyphs import page_lines
from quire.session import cut_lineage

PAGE = ["book", "page_num"]

# Duplicate headers, heading geometry, references, table text, formula width.
DUPLICATE_CHARS = 60
DUPLICATE_OPEN, DUPLICATE_CLOSE = "[DUPLICATE_HEADER]", "[/DUPLICATE_HEADER]"
HEADING_RATIO, MAX_RATIO, TOP_RATIO, LARGE_RATIO = 1.25, 3.0, 2.0, 1.6
HEADING_CHARS = (2, 80)
PAGE_HEIGHT, MARGIN_SHARE = 792.0, 0.05
MIN_GLYPHS = 10
REFERENCE_HEADING = (
    "(?imd)^\\s*(?:\\d*\\.?\\s*)?(?:references|bibliography|works\\s+cited|参考文献|参考资料|文献)\\s*[:：]?\\s*$"
    "|\\\\section\\*?\\{\\s*(?:references|bibliography|works\\s+cited|参考文献|参考资料|文献)\\s*\\}|\\\\begin\\{thebibliography\\}"
)
NUMBERED_REFERENCE = "\\A(?:\\[\\d+\\]|\\(\\d+\\)|\\d+\\.)\\s+."
YEAR = f"{T.WORD_START}(?:19|20)\\d{{2}}{T.WORD_END}"
AUTHORS = f"(?i),\\s*[A-Z][a-zA-Z\\-']+|{T.WORD_START}et\\s+al\\.|{T.WORD_START}vol\\.|{T.WORD_START}pp\\."
BRACKETED = "\\A\\[\\d+\\]"
TAIL_RUN, TAIL_SHARE, BRACKET_RUN, BRACKET_SHARE = 4, 0.6, 5, 0.5
EMPTY_CELL = "<EMPTY>"
FORMULA_WIDTH, BREAK_FROM, BREAK_TO = 140, 30, 110


def running_headers(pages: DataFrame) -> DataFrame:
    """Pages whose first non-blank line opens another page of the book too.

    Only first lines move.  A title that opens a third of all pages makes a skewed join key with one matching
    row, which adaptive execution splits.
    """
    first = T.strip(F.regexp_extract("text", f"\\A{T.SPACE}*([^\\n]*)", 1))
    lines = pages.select(*PAGE, first.alias("first_line"))
    repeated = lines.where("first_line <> ''").groupBy("book", "first_line").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    marked = lines.join(repeated, ["book", "first_line"], "left")
    return marked.select(*PAGE, "first_line", F.col("n").isNotNull().alias("is_running_header"))


def mark_duplicate_headers(value: Column) -> Column:
    """Tag the first repeat of a short line that directly follows its twin; drop the later repeats."""

    def repeated(trimmed: Column) -> Column:
        return F.transform(trimmed, lambda t, i: F.when(
            (i > 0) & (t != "") & (F.length(t) < DUPLICATE_CHARS) & (t == F.get(trimmed, i - 1)), t))

    def render(text: Column, repeats: Column) -> Column:
        def line(raw: Column, i: Column) -> Column:
            repeat = F.get(repeats, i)
            tagged = F.concat(F.lit(DUPLICATE_OPEN), repeat, F.lit(DUPLICATE_CLOSE))
            return F.when(repeat.isNull(), raw).when(F.array_position(repeats, repeat) == i + 1, tagged)

        rendered = F.filter(F.transform(T.split_newlines(text), line), lambda x: x.isNotNull())
        return F.when(F.exists(repeats, lambda r: r.isNotNull()), T.join_lines(rendered)).otherwise(text)

    trimmed = F.transform(T.split_newlines(value), T.strip)
    return T.let(T.let(trimmed, repeated), lambda repeats: render(value, repeats))


# ---- glyphs ------------------------------------------------------------------------------------------------------

# Footer zone and size, minimal evidence, grouping of glyphs into lines.
FOOTER_TOP, FOOTER_SIZE, MIN_GLYPHS, MIN_FOOTER_CHARS, ROW_HEIGHT = 0.84, 0.78, 10, 3, 2
LINE_TOLERANCE = 3.0


def remove_bottom_small_text(pages: DataFrame, glyphs: DataFrame) -> DataFrame:
    """Drop lines that contain the small print at the foot of a page.

    The median size comes from a histogram (combined map-side), and only glyphs in the footer zone move, so the
    glyph table itself is never shuffled.
    """
    inked = glyphs.where(~T.is_blank("ch"))
    sizes = inked.where("size > 0").groupBy(*PAGE, "size").agg(F.count(F.lit(1)).alias("n"))
    medians = upper_median(sizes, PAGE, "size", "n").where(F.col("total") >= MIN_GLYPHS).select(*PAGE, "median")
    low = inked.where(F.col("top") >= F.col("page_height") * FOOTER_TOP).select(*PAGE, "g_idx", "ch", "x0", "top", "size")
    # A glyph without a size counts as body text.
    small = low.join(medians, PAGE).where(F.when(F.col("size") > 0, F.col("size")).otherwise(F.col("median")) <= F.col("median") * FOOTER_SIZE)
    row = (F.bround(F.col("top") / ROW_HEIGHT, 0) * ROW_HEIGHT).alias("row")
    ordered = F.array_sort(F.collect_list(F.struct("x0", "g_idx", "ch")))
    texts = small.groupBy(*PAGE, row).agg(F.array_join(F.transform(ordered, lambda g: g["ch"]), "").alias("t"))
    notes = texts.select(*PAGE, _squeezed(F.col("t")).alias("t")).where(F.length("t") >= MIN_FOOTER_CHARS)
    per_page = notes.groupBy(*PAGE).agg(F.collect_set("t").alias("__notes"))
    joined = pages.join(per_page, PAGE, "left")
    return joined.withColumn("text", without_notes(F.col("text"), F.col("__notes"))).drop("__notes")


def without_notes(text: Column, notes: Column) -> Column:
    """Drop the lines that hold one of the squeezed ``notes``; a page without notes stays as it is."""

    def keep(line: Column) -> Column:
        return T.let(_squeezed(line), lambda s: ~F.exists(notes, lambda n: F.coalesce(s.contains(n), F.lit(False))))

    cleaned = T.strip(T.join_lines(F.filter(T.split_lines(text), keep)))
    return F.when(F.coalesce(F.size(notes), F.lit(0)) <= 0, text).otherwise(cleaned)


def _squeezed(value: Column) -> Column:
    return F.lower(F.regexp_replace(value, f"{T.SPACE}+", ""))


def upper_median(counts: DataFrame, keys: list[str], value: str, n: str) -> DataFrame:
    """Element ``total // 2`` of the sorted values, from a histogram of (value, n)."""
    histogram = counts.groupBy(*keys).agg(F.sum(n).alias("total"), F.array_sort(F.collect_list(F.struct(F.col(value).alias("v"), F.col(n).alias("n")))).alias("h"))
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("double").alias("median"))
    middle = F.floor(F.col("total") / 2)
    found = F.aggregate("h", start, lambda s, b: F.struct(
        (s["seen"] + b["n"]).alias("seen"), F.when(s["median"].isNull() & (s["seen"] + b["n"] > middle), b["v"]).otherwise(s["median"]).alias("median")))
    return histogram.select(*keys, "total", found["median"].alias("median"))


def glyphs_to_lines(glyphs: DataFrame) -> DataFrame:
    """Cluster the glyphs of a page into lines by a running mean of their height.

    Glyphs of equal height always stay together, so they are joined first, before anything moves; the sequential step then walks over
    the few distinct heights of a page.
    """
    lines = page_lines(glyphs, LINE_TOLERANCE)
    size = F.when(F.col("sized") > 0, F.col("sizes") / F.col("sized")).otherwise(0.0)
    return lines.select(*PAGE, "line_no", T.strip("text").alias("text"), F.round(size, 6).alias("size"), "y0", "x0")


# ---- headings and chapters ---------------------------------------------------------------------------------------


def heading_level(text: Column, size: Column, median: Column) -> Column:
    """1 chapter, 2 section, 3 subsection, from the size ratio and the wording."""
    ratio = F.when(median > 0, size / median).otherwise(1.0)
    dotted = F.regexp_extract(text, "\\A\\d+(?:\\.\\d+)+", 0)
    return (
        F.when(ratio > TOP_RATIO, 1).when(text.rlike("\\A(?:Chapter|CHAPTER|第\\s*[\\u4e00-\\u9fff\\d]+\\s*章)"), 1)
        .when(text.rlike("\\A(?:Section|SECTION|第\\s*[\\u4e00-\\u9fff\\d]+\\s*节)"), 2)
        .when(dotted != "", F.least(F.lit(3), T.count_char(dotted, ".") + 1))
        .when(text.rlike("\\A\\d+\\."), 2).when(ratio > LARGE_RATIO, 1).otherwise(2)
    )


def chapter_candidates(lines: DataFrame) -> DataFrame:
    """Headings of each page in order; directly repeated titles of a page shrink to the largest.

    Pages with fewer than ``MIN_GLYPHS`` glyphs have none.  ``page_height``, where the lines have it, sets the margins of a page.
    """
    packed = F.array_sort(F.collect_list(F.struct("line_no", T.strip("text").alias("text"), "size", "y0")))
    height = F.max("page_height") if "page_height" in lines.columns else F.lit(None).cast("double")
    pages = lines.groupBy(*PAGE).agg(packed.alias("l"), F.sum(F.length("text")).alias("glyphs"), F.coalesce(height, F.lit(PAGE_HEIGHT)).alias("height"))
    pages = pages.where(F.col("glyphs") >= MIN_GLYPHS)
    sizes = F.array_sort(F.filter(F.transform("l", lambda x: x["size"]), lambda s: s > 0))
    pages = pages.withColumn("median", F.get(sizes, F.floor(F.size(sizes) / 2).cast("int")))

    def is_chapter(x: Column) -> Column:
        chars = F.length(x["text"])
        return (
            (x["size"] > F.col("median") * HEADING_RATIO) & (x["size"] < F.col("median") * MAX_RATIO) & chars.between(*HEADING_CHARS)
            & x["text"].rlike("\\p{L}") & P.is_heading(x["text"])
            & x["y0"].between(F.col("height") * MARGIN_SHARE, F.col("height") * (1 - MARGIN_SHARE))
        )

    none = F.array().cast("array<struct<title: string, font_size: double, level: int>>")

    def add(found: Column, x: Column) -> Column:
        level = heading_level(x["text"], x["size"], F.col("median")).cast("int")
        item = F.struct(x["text"].alias("title"), F.bround(x["size"], 2).alias("font_size"), level.alias("level"))
        top = F.element_at(F.when(F.size(found) > 0, found), -1)
        same = F.coalesce(top["title"] == item["title"], F.lit(False))
        larger = F.concat(F.slice(found, F.lit(1), F.greatest(F.size(found) - 1, F.lit(0))), F.array(item))
        return F.when(~same, F.array_append(found, item)).when(item["font_size"] > top["font_size"], larger).otherwise(found)

    return pages.select(*PAGE, F.aggregate(F.filter("l", is_chapter), none, add).alias("items")).where(F.size("items") > 0)


def chapter_boundaries(lines: DataFrame, width: int = BLOCK_WIDTH) -> DataFrame:
    """Chapter starts of each book; a title repeated on the next page keeps the larger one.

    Sequentially, the last kept heading meets the first one of the next page.  That heading stands for its own
    page, or for the page before; in the second case the distance is two and a repeat counts as new.  So the
    state alternates along a run of repeats that grow no larger, and starts over at every other page: parity of
    the distance to the last such page decides, which is a running maximum over bounded blocks.
    """
    pages = cut_lineage(chapter_candidates(lines)).select(
        *PAGE, "items", F.size("items").alias("m"), F.get("items", 0)["title"].alias("first"), F.get("items", 0)["font_size"].alias("first_size"),
        F.element_at("items", -1)["title"].alias("last"), F.element_at("items", -1)["font_size"].alias("last_size"))
    before = pages.select("book", (F.col("page_num") + 1).alias("page_num"), F.col("last").alias("p_last"), F.col("last_size").alias("p_size"))
    linked = pages.drop("items").join(before, PAGE, "left").withColumns({
        "link": F.coalesce(F.col("p_last") == F.col("first"), F.lit(False)),
        "grows": F.coalesce(F.col("first_size") > F.col("p_size"), F.lit(False)),
    })
    anchor = (F.col("m") >= 2) | ~F.col("link") | F.col("grows")
    stated = with_running(linked, ["book"], "page_num", {"anchor": (F.when(anchor, F.col("page_num")), F.max)}, width, counted=True)
    stated = stated.withColumn("last_stands", (F.col("page_num") - F.col("anchor")) % 2 == 0)
    previous = stated.select("book", (F.col("page_num") + 1).alias("page_num"), F.col("last_stands").alias("p_stands"))
    following = stated.select("book", (F.col("page_num") - 1).alias("page_num"), F.col("link").alias("n_link"), F.col("first_size").alias("n_size"))
    joined = stated.join(previous, PAGE, "left").join(following, PAGE, "left")
    first_stands = F.when(F.col("m") == 1, F.col("last_stands")).otherwise(~F.col("link") | F.col("grows") | ~F.coalesce("p_stands", F.lit(False)))
    replaced = F.coalesce(F.col("n_link") & F.col("last_stands") & (F.col("n_size") > F.col("last_size")), F.lit(False))
    verdict = joined.select(*PAGE, first_stands.alias("first_stands"), (F.col("last_stands") & ~replaced).alias("last_kept"))
    items = pages.select(*PAGE, "m", F.posexplode("items").alias("i", "x")).join(verdict, PAGE)
    kept = ((F.col("i") > 0) | F.col("first_stands")) & ((F.col("i") < F.col("m") - 1) | F.col("last_kept"))
    return items.where(kept).select(*PAGE, "x.title", "x.level", "x.font_size", F.length("x.title").alias("char_count"))


# ---- formulas across pages and lines -----------------------------------------------------------------------------


def stitch_cross_page_formulas(pages: DataFrame, width: int = BLOCK_WIDTH) -> DataFrame:
    """Move the head of a page to the tail of the page before where a formula runs across the break.

    Whether a page with a single content line still has a tail depends on the break before it; along such pages
    the answer alternates, so it follows from the last page whose break does not depend on its predecessor.
    Only the edge lines of pages move between tasks; they are written once, since the steps after read them often.
    Page texts join once, on their unique key.
    """
    lines = T.split_lines("text")
    content = F.filter(T.positions(F.col("__l")), lambda i: _is_content(F.get(F.col("__l"), i)))
    edges = cut_lineage(pages.select(*PAGE, lines.alias("__l")).withColumn("__c", content).select(
        *PAGE, F.size("__c").alias("n"), T.strip(F.get("__l", F.get("__c", 0))).alias("head"),
        T.strip(F.get("__l", F.element_at(F.when(F.size("__c") > 0, F.col("__c")), -1))).alias("tail")))
    heads = edges.select("book", (F.col("page_num") - 1).alias("page_num"), F.col("head").alias("next_head"))
    unfinished = F.col("tail").rlike(P.UNFINISHED_PAGE_END) | P.opens_more(F.col("tail"))
    joins = F.coalesce(unfinished & F.col("next_head").rlike(P.PAGE_CONTINUATION), F.lit(False))
    paired = edges.join(heads, PAGE, "left").select(*PAGE, "n", "next_head", joins.alias("joins"))
    there = edges.select("book", (F.col("page_num") + 1).alias("page_num"), F.lit(True).alias("has_previous"))
    paired = paired.join(there, PAGE, "left")
    settled = (F.col("n") >= 2) | ~F.col("joins") | F.col("has_previous").isNull()
    last = F.when(settled, F.struct(F.col("page_num").alias("p"), F.col("joins").alias("link")))
    run = with_running(paired, ["book"], "page_num", {"last": (last, F.max)}, width, counted=True)
    linked = run.select(*PAGE, "next_head", (F.col("last.link") != ((F.col("page_num") - F.col("last.p")) % 2 != 0)).alias("link"))
    given = linked.where("link").select("book", (F.col("page_num") + 1).alias("page_num"), F.lit(True).alias("gave_head"))
    touched = linked.join(given, PAGE, "left").select(*PAGE, "link", F.when(F.col("link"), F.col("next_head")).alias("next_head"), F.coalesce("gave_head", F.lit(False)).alias("gave_head"))
    staged = pages.join(touched, PAGE).withColumn("__l", lines).withColumn("__c", content)
    tail_at = F.element_at(F.when(F.size("__c") > 0, F.col("__c")), -1)
    moved = F.transform("__l", lambda line, i: F.when(F.col("link") & (i == tail_at), F.concat(T.strip(line), F.lit(" "), F.col("next_head"))).otherwise(line))
    kept = F.filter(moved, lambda line, i: ~(F.col("gave_head") & (i == F.get("__c", 0))))
    stitched = F.col("link") | F.col("gave_head")
    return staged.withColumn("text", F.when(stitched, T.strip(T.join_lines(kept))).otherwise(F.col("text"))).withColumn(
        "stitched", stitched).drop("__l", "__c", "link", "gave_head", "next_head")


def _is_content(line: Column) -> Column:
    s = T.strip(line)
    return (s != "") & ~(s.startswith("[") & s.endswith("]"))


# Separators inside a page that is being cut into blocks: code points that no text may hold.
BLOCK_MARK, LINE_MARK, HEAD_MARK = "\ufdd0", "\ufdd1", "\ufdd2"


def _tested_lines(text: Column) -> Column:
    """Lines of a page with their number, whether they are headings or mathematics, and whether they go on from the one before."""
    lines = F.filter(F.transform(T.split_lines(text), lambda raw, i: F.struct(i.alias("line_no"), T.strip(raw).alias("line"))),
                     lambda x: ~(x["line"].startswith("[") & x["line"].endswith("]")))

    def test(found: Column) -> Column:
        return F.transform(found, lambda x, i: T.let(F.struct(x["line"].alias("line"), F.get(found, i - 1)["line"].alias("before"), x["line_no"].alias("line_no")), lambda y: T.let(
            F.struct(y.alias("y"), ((y["line"] != "") & P.is_text_heading(y["line"])).alias("heading")), lambda z: F.struct(
                z["y"]["line_no"].alias("line_no"), z["y"]["line"].alias("line"), z["heading"].alias("heading"), (~z["heading"] & P.is_math(z["y"]["line"])).alias("math"),
                F.coalesce(~z["heading"] & P.continues(z["y"]["before"], z["y"]["line"]), F.lit(False)).alias("goes_on")))))

    return T.let(lines, test)


def _kinds(tested: Column) -> Column:
    """One letter per line: (b)lank, (h)eading, (p)rose, (m)athematics that goes on, (M)athematics that does not.

    A formula goes on as long as each line explicitly continues the one before, so a line is mathematics when its run of
    continuations holds a mathematical line at or before it.  Runs are found in a string of one letter per line, upper case
    where a run starts.
    """

    def letter(x: Column, i: Column) -> Column:
        starts = x["heading"] | ~x["goes_on"] | F.coalesce(F.get(tested, i - 1)["heading"], F.lit(True))
        return F.when(starts, F.when(x["math"], "M").otherwise("N")).otherwise(F.when(x["math"], "m").otherwise("n"))

    runs = F.regexp_extract_all(F.array_join(F.transform(tested, letter), ""), F.lit("[Mm][mn]*|[Nn]"), F.lit(0))
    formula = F.flatten(F.transform(runs, lambda r: F.array_repeat(r.rlike("\\A[Mm]"), F.length(r))))
    return F.zip_with(tested, formula, lambda x, f: F.when(x["line"] == "", "b").when(x["heading"], "h").when(f, F.when(x["goes_on"], "m").otherwise("M")).otherwise("p"))


def _blocks(text: Column, show=None) -> Column:
    """Blocks of a page: kind, first line number, number of lines, and the lines joined by spaces, each as ``show`` gives it.

    A block starts where the kind changes, at every heading, and at mathematics that does not go on.  The page is joined with
    marks and cut at them, so nothing leaves the row.
    """

    def cut(both: Column) -> Column:
        lines, kinds = both["lines"], both["kinds"]

        def marked(x: Column, i: Column) -> Column:
            kind, before = F.get(kinds, i), F.get(kinds, i - 1)
            starts = kind.isin("h", "M") | F.coalesce(F.lower(kind) != F.lower(before), F.lit(True))
            shown = F.when(kind == "p", show(x["line"])).otherwise(x["line"]) if show else x["line"]
            return F.concat(F.when(starts, F.concat(F.lit(BLOCK_MARK), F.lower(kind), x["line_no"].cast("string"), F.lit(HEAD_MARK))).otherwise(F.lit(LINE_MARK)), shown)

        pieces = F.slice(F.split(F.array_join(F.transform(lines, marked), ""), BLOCK_MARK), 2, 2**30)
        return F.transform(pieces, lambda piece: T.let(F.split(piece, HEAD_MARK, 2), lambda h: F.struct(
            F.substring(h[0], 1, 1).alias("kind"), F.substring(h[0], 2, 20).cast("int").alias("first_line"),
            (T.count_char(h[1], LINE_MARK) + 1).cast("long").alias("lines"), F.replace(h[1], F.lit(LINE_MARK), F.lit(" ")).alias("t"))))

    return T.let(_tested_lines(text), lambda lines: T.let(F.struct(lines.alias("lines"), _kinds(lines).alias("kinds")), cut))


def formula_blocks(pages: DataFrame) -> DataFrame:
    """Formulas of a page, wrapped lines joined.  Pages are cut inside the row, with no exchange."""
    found = pages.select(*PAGE, F.explode_outer(F.filter(_blocks(F.col("text")), lambda b: b["kind"] == "m")).alias("b")).where("b IS NOT NULL")
    return found.select(*PAGE, "b.first_line", "b.lines", F.col("b.t").alias("formula"))


def render_formula_line(s: Column) -> Column:
    """Display math around a line that needs it."""
    shown = F.concat(F.lit("\\[\n"), s, F.lit("\n\\]"))
    symbolic = s.rlike("[$^_=]|\\\\[a-zA-Z]+") | (s.rlike(P.GREEK_OR_SIGN) & s.rlike("[A-Za-z0-9]"))
    return (
        F.when(s.rlike("\\A(?:\\\\begin\\{|\\\\end\\{|\\\\\\[|\\\\\\]|\\\\\\(|\\\\\\)|\\$)"), s)
        .when(s.rlike(P.LONE_SYMBOLS), "").when(symbolic, shown).otherwise(s)
    )


def break_points(formula: Column) -> Column:
    """Positions after a plus or minus outside all brackets."""
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c"), F.lit("").alias("prev"), F.array().cast("array<int>").alias("at"))

    def depth(value: Column, ch: Column, opener: str, closer: str) -> Column:
        return F.when(ch == opener, value + 1).when(ch == closer, F.greatest(value - 1, F.lit(0))).otherwise(value)

    def step(s: Column, ch: Column) -> Column:
        here = ch.isin("+", "-") & (s["a"] + s["b"] + s["c"] == 0) & (s["i"] > 0) & ~s["prev"].isin("^", "_")
        return F.struct(
            (s["i"] + 1).alias("i"), depth(s["a"], ch, "{", "}").alias("a"), depth(s["b"], ch, "(", ")").alias("b"), depth(s["c"], ch, "[", "]").alias("c"),
            ch.alias("prev"), F.when(here, F.array_append(s["at"], s["i"] + 1)).otherwise(s["at"]).alias("at"))

    return F.aggregate(F.split(formula, ""), start, step, lambda s: s["at"])


def render_formula(formula: Column) -> Column:
    """A formula as display math; a long one breaks after top-level signs into aligned rows."""
    long = T.let(break_points(formula), lambda points: T.let(_rows_between(formula, points), lambda rows: F.when(
        F.size(rows) > 1, _aligned(rows)).otherwise(render_formula_line(formula))))
    return F.when(formula == "", "").when(F.length(formula) <= FORMULA_WIDTH, render_formula_line(formula)).otherwise(long)


def _aligned(rows: Column) -> Column:
    marked = F.transform(rows, lambda r, i: F.concat(F.when(i == 0, F.lit("& ")).otherwise("&\\quad "), r, F.when(i < F.size(rows) - 1, " \\\\").otherwise("")))
    return F.concat(F.lit("\\[\n\\begin{aligned}\n"), T.join_lines(marked), F.lit("\n\\end{aligned}\n\\]"))


def _rows_between(formula: Column, points: Column) -> Column:
    """Cut at the last break 30 to 110 characters on, as long as more than a full row is left."""
    start = F.struct(F.lit(0).alias("from"), F.array().cast("array<string>").alias("rows"), F.lit(False).alias("done"))

    def step(s: Column, _: Column) -> Column:
        near = F.filter(points, lambda p: p.between(s["from"] + BREAK_FROM, s["from"] + BREAK_TO))
        more = ~s["done"] & (F.length(formula) - s["from"] > FORMULA_WIDTH) & (F.size(near) > 0)
        point = F.element_at(F.when(F.size(near) > 0, near), -1)
        row = T.strip(F.substring(formula, s["from"] + 1, point - s["from"]))
        return F.struct(F.when(more, point).otherwise(s["from"]).alias("from"), F.when(more, F.array_append(s["rows"], row)).otherwise(s["rows"]).alias("rows"), (~more).alias("done"))

    def finish(s: Column) -> Column:
        return F.array_append(s["rows"], T.strip(F.substring(formula, s["from"] + 1, F.length(formula))))

    return F.aggregate(F.concat(F.array(F.lit(0)), points), start, step, finish)


def page_blocks(pages: DataFrame) -> DataFrame:
    """Convert page text to LaTeX by rule: headings, formulas, paragraphs, and the table block at the end.

    A page is cut and rendered inside its row, with no exchange.
    """
    marker = "[STRUCTURED_TABLE_CONTEXT]"
    whole = T.strip(F.replace("text", F.lit("[TWO_COLUMN_PAGE]"), F.lit("")))
    cut = F.instr(whole, marker)
    parts = pages.select(*PAGE, F.when(cut > 0, F.substring(whole, F.lit(1), cut - 1)).otherwise(whole).alias("text"),
                         F.when(cut > 0, F.substring(whole, cut + len(marker), F.length(whole))).alias("table"))

    def render(b: Column) -> Column:
        return F.when(b["kind"] == "h", F.concat(F.lit("\\section*{"), L.escape_tex(b["t"]), F.lit("}"))).when(b["kind"] == "m", render_formula(b["t"])).otherwise(T.strip(b["t"]))

    shown = F.transform(F.filter(_blocks(F.col("text"), L.escape_tex_keep_math), lambda b: b["kind"] != "b"), render)
    tables = F.filter(F.array(tabular_from_context(F.col("table"))), lambda t: F.coalesce(t, F.lit("")) != "")
    return parts.select(*PAGE, F.array_join(F.concat(F.coalesce(F.filter(shown, lambda t: ~T.is_blank(t)), F.array().cast("array<string>")), F.coalesce(tables, F.array().cast("array<string>"))), "\n\n").alias("latex"))


# ---- references --------------------------------------------------------------------------------------------------


def _is_reference(line: Column) -> Column:
    s = T.strip(line)
    return s.rlike(NUMBERED_REFERENCE) | (s.rlike(YEAR) & s.rlike(AUTHORS))


def split_references(pages: DataFrame) -> DataFrame:
    """Cut the reference list off: at a heading, else at a tail of reference-like lines, else at a run of [n] lines.

    Lines become one letter each (r reference, b blank, n other); a regex over the letters finds the last run
    with enough references, however many blank lines it holds.
    """
    staged = pages.withColumn("__l", T.split_newlines(F.regexp_replace("text", "\\n\\z", "")))
    letters = F.array_join(F.transform("__l", lambda x: F.when(T.is_blank(x), "b").when(_is_reference(x), "r").otherwise("n")), "")
    brackets = F.array_join(F.transform("__l", lambda x: F.when(T.strip(x).rlike(BRACKETED), "x").otherwise("o")), "")
    staged = staged.withColumns({"__f": letters, "__x": brackets, "__heading": F.when(F.col("text").rlike(REFERENCE_HEADING), F.length(F.get(F.split("text", REFERENCE_HEADING, 2), 0)))})

    def offset(line: Column) -> Column:
        return T.total(F.transform(F.slice("__l", F.lit(1), line), lambda x: F.length(x) + 1)).cast("int")

    tail = f"\\A((?:.*n)?)(?=(?:b*r){{{TAIL_RUN}}})"
    run = F.when(F.col("__f").rlike(tail), F.length(F.regexp_extract("__f", tail, 1)))
    run = F.when(F.substring(F.col("__f"), run + 1, F.lit(1)) == "b", run + 1).otherwise(run)
    starts = F.filter(T.positions(F.col("__l")), lambda i: (
        (F.substring(F.col("__x"), i + 1, F.lit(BRACKET_RUN)) == "x" * BRACKET_RUN) & ((i == 0) | (F.substring(F.col("__x"), i, F.lit(1)) == "o"))
        & (offset(i) / F.greatest(F.length("text"), F.lit(1)) > BRACKET_SHARE)))
    staged = staged.withColumns({"__tail": run, "__bracket": F.get(starts, 0)})
    tail_ok = F.col("__tail") / F.greatest(F.size("__l"), F.lit(1)) >= TAIL_SHARE
    cut = (
        F.when(F.col("__heading").isNotNull(), F.col("__heading")).when(tail_ok, offset(F.col("__tail")))
        .when(F.col("__bracket").isNotNull(), offset(F.col("__bracket")))
    )
    staged = staged.withColumns({"__cut": cut, "rule": F.when(F.col("__heading").isNotNull(), "heading").when(tail_ok, "tail")
                                 .when(F.col("__bracket").isNotNull(), "brackets").otherwise("")})
    blank = T.is_blank("text")
    main = F.when(blank, "").when(F.col("__cut").isNull(), F.col("text")).otherwise(T.rstrip(F.substring(F.col("text"), F.lit(1), F.col("__cut"))))
    references = F.when(blank | F.col("__cut").isNull(), "").otherwise(
        F.ltrim(F.substring(F.col("text"), F.col("__cut") + 1, F.length("text")), F.lit("\n")))
    return staged.select(*PAGE, "rule", main.alias("main"), references.alias("references"))


# ---- tables ------------------------------------------------------------------------------------------------------


def clean_cell(cell: Column) -> Column:
    squeezed = F.regexp_replace(T.strip(F.replace(cell, F.lit("\n"), F.lit(" "))), f"{T.SPACE}+", " ")
    return F.coalesce(F.when(squeezed != "", squeezed), F.lit(EMPTY_CELL))


def table_context(cells: DataFrame) -> DataFrame:
    """Each extracted table as text: a header, then one line per row on the grid of columns 1 to the last.

    A column number that a row does not have is an empty cell.  ``table_no``, where the cells have it, is the number of the
    table on its page and goes into the header.  Cells meet per row first, rows per table second: a task never holds more
    than one row's cells or one table's lines.  Empty cells are filled in by the gaps between column numbers, so a row costs what it shows.
    """
    keys = ["table_id", *(["table_no"] if "table_no" in cells.columns else [])]
    packed = F.array_sort(F.collect_list(F.struct("col_no", clean_cell(F.col("cell")).alias("t"))))
    rows = cells.where("col_no >= 1").groupBy(*keys, "row_no").agg(packed.alias("row"), F.max("col_no").alias("last"))
    rows = rows.select(*keys, "row_no", "last", T.let(F.col("row"), _filled_row).alias("line"))
    tables = rows.groupBy(*keys).agg(F.max("last").alias("cols"), F.array_sort(F.collect_list(F.struct("row_no", "line", "last"))).alias("rows"))
    missing = F.lit(f" | {EMPTY_CELL}")
    lines = F.transform("rows", lambda r, i: F.concat(
        F.lit("ROW "), (i + 1).cast("string"), F.lit(": "), r["line"], F.repeat(missing, (F.col("cols") - r["last"]).cast("int"))))
    number = F.col("table_no").cast("string") if len(keys) > 1 else F.lit("1")
    header = F.concat(F.lit("[TABLE "), number, F.lit("] cols="), F.col("cols").cast("string"))
    return tables.select(*keys, T.join_lines(F.concat(F.array(header), lines)).alias("table_text"))


def _filled_row(row: Column) -> Column:
    """The cells of a row, sorted by column, as text up to its last cell: each cell brings the empty ones before it."""

    def with_gap(cell: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(row, i - 1)["col_no"]).otherwise(F.lit(0))
        gap = (cell["col_no"] - before - 1).cast("int")
        # Of two cells at one place the first counts.
        return F.when(gap < 0, F.array().cast("array<string>")).otherwise(F.concat(F.array_repeat(F.lit(EMPTY_CELL), gap), F.array(cell["t"])))

    return F.array_join(F.flatten(F.transform(row, with_gap)), " | ")


def tabular_from_context(text: Column) -> Column:
    """A LaTeX table from ROW lines; '' where there are none."""
    pattern = f"(?im)^{T.SPACE}*ROW{T.SPACE}+\\d+{T.SPACE}*:{T.SPACE}*(.+)$"
    rows = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda r: F.transform(
        F.split(r, "\\|"), lambda c: L.escape_tex(F.regexp_replace(T.strip(c), "\\A\\z", L.FILLER))))
    return F.when(F.coalesce(F.size(rows), F.lit(0)) <= 0, "").otherwise(T.let(rows, lambda r: T.let(F.array_max(F.transform(r, F.size)), lambda w: _tabular(r, w))))


def _tabular(rows: Column, width: Column) -> Column:
    lines = F.transform(rows, lambda r: F.concat(F.array_join(F.concat(r, F.array_repeat(F.lit(L.FILLER), width - F.size(r))), " & "), F.lit(" \\\\\n\\hline")))
    spec = F.concat(F.lit("\\begin{tabular}{|"), F.repeat(F.lit("l|"), width), F.lit("}\n\\hline"))
    return T.join_lines(F.concat(F.array(spec), lines, F.array(F.lit("\\end{tabular}"))))


def table_rows_from_context(tables: DataFrame) -> DataFrame:
    return tables.select("table_id", tabular_from_context(F.col("table_text")).alias("tabular"))


# ---- marked text -------------------------------------------------------------------------------------------------


def _sections(text: Column, marker: str) -> Column:
    """(number, block) for each marked section; text before the first marker belongs to none."""
    blocks = F.slice(F.split(text, marker), 2, 2**30)
    numbers = F.regexp_extract_all(text, F.lit(marker), F.lit(1))
    return F.arrays_zip(numbers.alias("n"), blocks.alias("block"))


def page_block_split(documents: DataFrame, keys: list[str]) -> DataFrame:
    """Page blocks of generated documents, cut at their page markers."""
    exploded = documents.select(*keys, F.explode_outer(_sections(F.col("tex"), L.PAGE_MARKER)).alias("s")).where("s IS NOT NULL")
    return exploded.select(*keys, F.col("s.n").cast("int").alias("page"), T.strip("s.block").alias("block")).where("block <> ''")


def parse_batch_response(responses: DataFrame, requested: DataFrame) -> DataFrame:
    """Pages found in a batch answer: only requested ones, only with text; an answer without markers yields nothing."""
    keys = ["book", "chunk"]
    exploded = responses.select(*keys, F.posexplode_outer(_sections(F.col("content"), "\\[PAGE\\s+(\\d+)\\]")).alias("i", "s")).where("s IS NOT NULL")
    tag = "\\[DUPLICATE_(?:HEADER|FOOTER)\\].*?\\[/DUPLICATE_(?:HEADER|FOOTER)\\]"
    rows = exploded.select(*keys, "i", (F.col("s.n").try_cast("int") - 1).alias("page_num"), T.strip(F.regexp_replace("s.block", tag, "")).alias("text"))
    wanted = requested.select(*keys, "page_num")
    found = rows.where("text <> ''").join(wanted, [*keys, "page_num"], "left_semi")
    return found.select(*keys, "page_num", F.col("i").alias("section_no"), "text")


MESSAGE = "\\.tex:(\\d+):\\s*(.+)"
MAX_LOG_ERRORS = 10


def compile_log_errors(logs: DataFrame, limit: int = MAX_LOG_ERRORS) -> DataFrame:
    """The first errors of each TeX log, wrapped messages joined, each with its source line where the log tells it."""
    found = T.let(T.let(T.split_lines("log"), _log_events), lambda events: _first_errors(events, limit))
    errors = logs.select("log_id", F.posexplode_outer(found).alias("at", "error")).where("error IS NOT NULL")
    return errors.select("log_id", (F.col("at") + 1).alias("error_no"), "error.line", "error.message")


def _log_events(lines: Column) -> Column:
    """What a log tells, in order, as (kind, number, message): an error with its file, a bare error, or a source line."""

    def starts(line: Column) -> Column:
        return T.is_blank(line) | T.strip(line).rlike("\\.tex:\\d+:|\\A! |\\Al\\.")

    def message(bounds: Column, start: Column, k: Column) -> Column:
        first = F.get(lines, start)
        wrapped = F.slice(lines, start + 2, F.coalesce(F.get(bounds, k + 1), F.size(lines)) - start - 1)
        return F.when(first.rlike("\\.tex:\\d+:"), F.concat(first, F.array_join(F.transform(wrapped, T.strip), ""))).otherwise(first)

    def event(raw: Column) -> Column:
        clean = T.strip(F.replace(raw, F.lit("\r"), F.lit("")))
        text = T.strip(F.regexp_extract(clean, MESSAGE, 2))
        kind = (
            F.when(clean.rlike(MESSAGE), F.when(text.contains("Fatal error"), "skip").otherwise("file"))
            .when(T.strip(raw).rlike("\\Al\\.\\d+"), "line").when(raw.startswith("! "), "bang").otherwise("skip"))
        number = F.coalesce(F.regexp_extract(clean, MESSAGE, 1).try_cast("int"), F.regexp_extract(T.strip(raw), "\\Al\\.(\\d+)", 1).try_cast("int"))
        shown = F.when(clean.rlike(MESSAGE), text).otherwise(T.strip(F.substring(raw, 3, 2**31 - 1)))
        return F.struct(kind.alias("kind"), number.alias("number"), shown.alias("message"))

    bounds = F.filter(T.positions(lines), lambda i: starts(F.get(lines, i)))
    raws = T.let(bounds, lambda found: F.transform(found, lambda start, k: message(found, start, k)))
    return F.filter(F.transform(raws, event), lambda e: e["kind"] != "skip")


def _first_errors(events: Column, limit: int) -> Column:
    """The first errors with their lines: a bare error takes the last line named before it, else one that follows at once."""
    paired = F.transform(events, lambda e, i: F.struct(e.alias("e"), F.get(events, i + 1).alias("next")))
    start = F.struct(F.lit(None).cast("int").alias("known"), F.array().cast("array<struct<line:int,message:string>>").alias("out"))

    def step(state: Column, pair: Column) -> Column:
        e, after = pair["e"], pair["next"]
        known = F.coalesce(F.when(e["kind"].isin("file", "line"), e["number"]), state["known"])
        line = F.when(e["kind"] == "file", e["number"]).otherwise(F.coalesce(known, F.when(after["kind"] == "line", after["number"])))
        counts = (e["kind"] != "line") & (F.size(state["out"]) < limit)
        error = F.array(F.struct(line.alias("line"), e["message"].alias("message")))
        return F.struct(known.alias("known"), F.when(counts, F.concat(state["out"], error)).otherwise(state["out"]).alias("out"))

    return F.aggregate(paired, start, step, lambda s: s["out"])
