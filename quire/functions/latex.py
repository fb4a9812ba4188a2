"""Column expressions over LaTeX source."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import text as T

# The ten characters that need escaping.  The first seven take a backslash.
BACKSLASHED = "[&%$#_{}]"
SPELLED = {"~": "\\textasciitilde{}", "^": "\\textasciicircum{}"}
BACKSLASH = "\\textbackslash{}"

# A complete inline formula on one line.
INLINE_MATH = "\\\\\\([^\\r\\n]*?\\\\\\)"

# The three rewrite sets, applied in order.  A rule is (needle, pattern, replacement); text without
# the needle (compared in lower case where the pattern ignores case) cannot match, which spares the regex on most pages.
_TRANSPOSED = "$1^{\\\\mathsf{T}}"
_NAME = "([A-Za-z](?:_[a-zA-Z0-9]+)?)"
_W = f"({T.WORD})"
EXTRACT_RULES = {
    "dot_transpose": (".T", f"{_NAME}\\.(T)", _TRANSPOSED),
    "space_transpose": ("T", f"{_NAME}{T.SPACE}+(T)(?![a-zA-Z{{])", _TRANSPOSED),
    "lower_transpose": (".t", f"([A-Z])\\.t{T.WORD_END}", _TRANSPOSED),
    "power": ("^", f"{_W}\\^(\\d+)(?![}}a-zA-Z])", "$1^{$2}"),
    "top": ("\\top", f"{_W}{T.SPACE}*\\\\top{T.WORD_END}", "$1^{\\\\top}"),
    "tag": ("\\tag{", "\\\\tag\\{([^}]*)\\}", "\\\\qquad ($1)"),
}
TRANSPOSE_RULES = {
    "dot_transpose": (".T", f"{_NAME}\\.(T)", _TRANSPOSED),
    "space_transpose": ("T", f"{_NAME}{T.SPACE}+(T)(?![a-zA-Z.])", _TRANSPOSED),
    "lower_transpose": (".t", f"([A-Z])\\.t{T.WORD_END}", _TRANSPOSED),
    "top": ("\\top", f"{_W}{T.SPACE}*\\\\top{T.WORD_END}", "$1^{\\\\top}"),
    "tab_top": ("\top", f"{_W}\top{T.WORD_END}", "$1^{\\\\top}"),
    "mathsf": ("\\mathsf{T}", f"{_W}{T.SPACE}*\\\\mathsf\\{{T\\}}", _TRANSPOSED),
    "letter_power": ("^", f"{_W}\\^([A-Za-z])(?![{{a-zA-Z])", "$1^{$2}"),
    "hermitian": (".H", f"{_W}\\.H{T.WORD_END}", "$1^{\\\\dagger}"),
}
# Commands to normalise, then bare words to turn into commands.
COMMANDS = {"le": "leq", "ge": "geq", "ne": "neq"}
BARE_WORDS = {
    "infinity": "infty", "le": "leq", "ge": "geq", "ne": "neq", "leq": "leq", "geq": "geq", "sum": "sum", "prod": "prod",
    "int": "int", "alpha": "alpha", "beta": "beta", "gamma": "gamma", "delta": "delta", "lambda": "lambda", "mu": "mu",
    "sigma": "sigma", "phi": "phi", "varphi": "varphi", "psi": "psi", "omega": "omega", "epsilon": "epsilon",
}
NOTATION_RULES = {
    "power": ("^", f"{_W}\\^(\\d+)(?![}}a-zA-Z])", "$1^{$2}"),
    **{f"cmd_{k}": (f"\\{k}", f"(?i)\\\\{k}{T.WORD_END}", f"\\\\{v}") for k, v in COMMANDS.items()},
    **{f"word_{k}": (k, f"(?i)(?<![\\\\-]){T.WORD_START}{k}{T.WORD_END}(?!-)", f"\\\\{v}") for k, v in BARE_WORDS.items()},
}
RULE_SETS = {"extract": EXTRACT_RULES, "transpose": TRANSPOSE_RULES, "notation": NOTATION_RULES}

# Commands of a document frame.
WRAPPER_COMMANDS = [
    "\\\\documentclass(\\[[^\\n]*?\\])?\\{[^\\n]*?\\}", "\\\\usepackage(\\[[^\\n]*?\\])?\\{[^\\n]*?\\}",
    "\\\\begin\\{document\\}", "\\\\end\\{document\\}", "\\\\title\\{[^\\n]*?\\}", "\\\\author\\{[^\\n]*?\\}",
    "\\\\date\\{[^\\n]*?\\}", "\\\\maketitle",
]


def escape_tex(value: Column) -> Column:
    """Escape the ten special characters, each input character once.

    Splitting at backslashes first keeps the backslashes that escaping adds apart from those of the input.
    """

    def piece(part: Column) -> Column:
        part = F.regexp_replace(part, f"({BACKSLASHED})", "\\\\$1")
        for char, spelled in SPELLED.items():
            part = F.replace(part, F.lit(char), F.lit(spelled))
        return part

    return F.array_join(F.transform(F.split(value, "\\\\"), piece), BACKSLASH)


def escape_tex_keep_math(value: Column) -> Column:
    """Escape prose, leaving complete single-line ``\\( ... \\)`` formulas as they are."""
    tokens = F.regexp_extract_all(value, F.lit(f"(?s){INLINE_MATH}|.+?(?={INLINE_MATH}|\\z)"), F.lit(0))
    whole = f"\\A{INLINE_MATH}\\z"
    mixed = F.array_join(F.transform(tokens, lambda t: F.when(t.rlike(whole), t).otherwise(escape_tex(t))), "")
    return F.when(value.contains("\\("), mixed).otherwise(escape_tex(value))


def strip_wrapper(value: Column) -> Column:
    """Remove the document frame (class, packages, title block) and squeeze blank lines."""
    for pattern in WRAPPER_COMMANDS:
        value = F.regexp_replace(value, pattern, "")
    return T.strip(T.squeeze_blank_lines(value))


def drop_lines(value: Column, drop) -> Column:
    return T.join_lines(F.filter(T.split_newlines(value), lambda line: ~drop(T.strip(line))))


def drop_page_numbers(value: Column) -> Column:
    """Drop lines that hold nothing but a number of two to four digits."""
    return drop_lines(value, lambda line: line.rlike("\\A[0-9]{2,4}\\z"))


def drop_rules(value: Column) -> Column:
    """Drop lone horizontal rules; table lines stay."""
    return drop_lines(value, lambda line: line.isin("\\hrule", "\\HRule"))


# ---- display math ------------------------------------------------------------------------------------------------

# Escaped delimiters, a display block, and what makes a body trivial or prose.
ESCAPED_DELIMITER = "\\\\textbackslash\\{\\}\\s*\\\\?([\\[\\]])"
DISPLAY = "(?s)\\\\\\[(.*?)\\\\\\]"
DELIMITER = "\\\\[\\[\\]]"
TRIVIAL_BODY = "\\A(?:[√∑∫∏±∓≈≠≤≥=+\\-*/·.,:;()\\[\\]{}|]+|[A-Za-z0-9]|\\\\[A-Za-z]+)\\z"
FORMULA_COMMAND = "\\\\(?:frac|sum|int|begin|left|right)"
CJK_CHARS, CJK_LENGTH, WORDS, WORDS_LENGTH = 8, 24, 6, 60


def is_formula_body(body: Column) -> Column:
    compact = F.regexp_replace(body, f"{T.SPACE}+", "")
    return (compact != "") & ~compact.rlike(TRIVIAL_BODY)


def is_prose_body(body: Column) -> Column:
    body = T.strip(body)
    cjk = (T.count_matches(body, "[\\u4e00-\\u9fff]") >= CJK_CHARS) & (F.length(body) >= CJK_LENGTH)
    words = (T.count_matches(body, "[A-Za-z]{3,}") >= WORDS) & (F.length(body) >= WORDS_LENGTH) & ~body.rlike(FORMULA_COMMAND)
    return cjk | words


def repair_display(value: Column) -> Column:
    """Keep well-paired display blocks only: flatten nested ones, drop stray delimiters and trivial bodies, free prose.

    A block runs from an opener to the first closer; every other delimiter is stray.
    """

    def render(_: Column, inner: Column) -> Column:
        body = T.strip(F.regexp_replace(inner, DELIMITER, ""))
        shown = F.when(is_prose_body(body), body).otherwise(F.concat(F.lit("\\[\n"), body, F.lit("\n\\]")))
        return F.when(is_formula_body(body), shown).otherwise(F.lit(""))

    cleaned = F.regexp_replace(value, ESCAPED_DELIMITER, "")
    return T.replace_matches(cleaned, DISPLAY, render, 1, lambda text: F.regexp_replace(text, DELIMITER, ""))


# ---- align environments ------------------------------------------------------------------------------------------

# Aligned environments and what may surround them.
ALIGN = "(?is)\\\\begin\\{align\\*?\\}(.*?)\\\\end\\{align\\*?\\}"
ALIGNED = "(?is)\\\\begin\\{aligned\\}.*?\\\\end\\{aligned\\}"
UNWRAP_ALIGN = [
    ("(?i)(?:\\\\\\[|\\$\\$)\\s*(\\\\begin\\{align\\*?\\})", "$1"),
    ("(?i)(\\\\end\\{align\\*?\\})\\s*(?:\\\\\\]|\\$\\$)", "$1"),
]
LAST_EQUATION_MARK = "(?s).*\\\\(begin|end)\\{(?:equation\\*?|displaymath)\\}"


def _aligned_body(body: Column) -> Column:
    def finish(line: Column, last: Column) -> Column:
        broken = F.when(~last & ~line.endswith("\\\\"), F.concat(line, F.lit(" \\\\"))).otherwise(line)
        needs_mark = ~broken.contains("&") & broken.contains("=") & ~broken.startswith("\\")
        return F.when(needs_mark, F.regexp_replace(broken, "(?s)\\A([^=]*?)\\s*=\\s*", "$1 &= ")).otherwise(broken)

    lines = F.filter(F.transform(T.split_lines(body), T.strip), lambda line: line != "")
    finished = T.let(lines, lambda ls: F.transform(ls, lambda line, i: finish(line, i == F.size(ls) - 1)))
    return F.regexp_replace(T.strip(T.join_lines(finished)), "\\\\\\\\\\s*\\z", "")


def align_to_aligned(value: Column) -> Column:
    """align environments become display blocks with aligned; a bare aligned gets a display block around it."""
    for pattern, replacement in UNWRAP_ALIGN:
        value = F.regexp_replace(value, pattern, replacement)

    def render(_: Column, inner: Column) -> Column:
        body = _aligned_body(inner)
        return F.when(body == "", "").otherwise(F.concat(F.lit("\\[\n\\begin{aligned}\n"), body, F.lit("\n\\end{aligned}\n\\]")))

    return _wrap_aligned(T.replace_matches(value, ALIGN, render, 1))


def _wrap_aligned(value: Column) -> Column:
    def wrap(parts: Column, block: Column, k: Column) -> Column:
        pieces, blocks = F.slice(parts["pieces"], 1, k + 1), F.slice(parts["blocks"], 1, k)
        before = F.array_join(F.flatten(F.zip_with(pieces, blocks, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
        head, tail = T.rstrip(before), T.lstrip(F.get(parts["pieces"], k + 1))
        shown = (head.endswith("\\[") & tail.startswith("\\]")) | (head.endswith("$$") & tail.startswith("$$"))
        in_equation = F.regexp_extract(before, LAST_EQUATION_MARK, 1) == "begin"
        return F.when(shown | in_equation, block).otherwise(F.concat(F.lit("\n\\[\n"), T.strip(block), F.lit("\n\\]\n")))

    def assemble(parts: Column) -> Column:
        wrapped = F.transform(parts["blocks"], lambda block, k: wrap(parts, block, k))
        return F.array_join(F.zip_with(parts["pieces"], wrapped, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")

    blocks = F.regexp_extract_all(value, F.lit(ALIGNED), F.lit(0))
    return T.let(F.struct(F.split(value, ALIGNED).alias("pieces"), blocks.alias("blocks")), assemble)


# ---- tables ------------------------------------------------------------------------------------------------------

# Table environments, lines that are no data, the filler of short rows.
TABULAR_BLOCK = "(?is)(\\\\begin\\{tabular\\*?\\}(?:\\[[^\\]]*\\])?\\{([^{}]*)\\})(.*?)(\\\\end\\{tabular\\*?\\})"
EMPTY_TABULAR = (
    "(?is)(\\\\begin\\{tabular\\*?\\}(?:\\[[^\\]]*\\])?\\{[^}]*\\})((?:\\s*&[^\\n]*\\n)*)\\s*(\\\\end\\{tabular\\*?\\})"
)
RULE_LINE = "\\A\\\\(?:hline|toprule|midrule|bottomrule|cmidrule|cline)"
SPANNING = "\\\\multicolumn|\\\\multirow"
COLUMN_LETTERS = "[clrXSPQ]"
FILLER = "--"
CELL_MARK = "(?<!\\\\)&"


def column_count(spec: Column) -> Column:
    """Columns that a table spec declares."""
    bare = F.regexp_replace(F.regexp_replace(spec, f"[|]|{T.SPACE}", ""), "[@><]\\{[^{}]*\\}", "")
    return T.count_matches(F.regexp_replace(bare, "[pmb]\\{[^{}]*\\}", "P"), COLUMN_LETTERS)


def is_data_line(line: Column) -> Column:
    s = T.strip(line)
    spans = s.startswith("\\multicolumn") | s.startswith("\\multirow")
    return (s != "") & ~s.startswith("%") & ~s.rlike(RULE_LINE) & (spans | s.contains("&"))


def repair_row(line: Column, columns: Column) -> Column:
    """Pad a short row, fold surplus cells into the last, and end it with a row break; other lines stay."""
    bare = T.rstrip(F.regexp_replace(T.rstrip(line), "\\\\\\\\\\s*\\z", ""))
    bare = T.rstrip(F.regexp_replace(bare, f"{CELL_MARK}\\s*\\z", ""))
    row = T.let(F.transform(F.split(bare, CELL_MARK), T.strip), lambda cells: _fitted(cells, columns))
    fixed = F.when((columns > 1) & ~line.rlike(SPANNING), row).otherwise(bare)
    return F.when(is_data_line(line), F.concat(T.rstrip(fixed), F.lit(" \\\\"))).otherwise(line)


def _fitted(cells: Column, columns: Column) -> Column:
    padded = F.concat(cells, F.array_repeat(F.lit(FILLER), F.greatest(columns - F.size(cells), F.lit(0)).cast("int")))
    folded = F.concat(F.slice(cells, F.lit(1), F.greatest(columns - 1, F.lit(0)).cast("int")),
                      F.array(F.array_join(F.slice(cells, F.greatest(columns, F.lit(1)).cast("int"), F.size(cells)), " \\& ")))
    return F.array_join(F.when(F.size(cells) > columns, folded).otherwise(padded), " & ")


def repair_tabular_blocks(value: Column) -> Column:
    """Repair the rows of every closed table with two columns or more."""

    def render(whole: Column, begin: Column, spec: Column, body: Column, end: Column) -> Column:
        columns = column_count(spec)
        lines = F.transform(T.split_lines(body), lambda line: F.when(is_data_line(line), repair_row(T.rstrip(line), columns)).otherwise(line))
        fixed = F.concat(begin, F.lit("\n"), T.strip(T.join_lines(lines)), F.lit("\n"), end)
        return F.when(columns <= 1, whole).otherwise(fixed)

    return T.replace_matches(value, TABULAR_BLOCK, render, 4)


def fill_empty_tables(value: Column) -> Column:
    """A table without content gets one blank row, so that it compiles."""

    def render(whole: Column, begin: Column, body: Column, end: Column) -> Column:
        compact = F.regexp_replace(body, f"{T.SPACE}+", "")
        spec = F.regexp_extract(begin, "(?s).*\\{([^{}]*)\\}", 1)
        blank = F.array_join(F.array_repeat(F.lit(" " * 8), F.greatest(column_count(spec), F.lit(2)).cast("int")), " & ")
        empty = (compact == "") | (T.count_char(compact, "&") < 2)
        return F.when(empty, F.concat(begin, F.lit("\n"), blank, F.lit("\n"), end)).otherwise(whole)

    return T.replace_matches(value, EMPTY_TABULAR, render, 3)


def repair_table_lines(value: Column) -> Column:
    """Repair rows line by line: also in tables that never close, which get closed; runs of blank lines shrink to one."""
    start = F.struct(F.lit(False).alias("inside"), F.lit(0).cast("long").alias("columns"), F.lit(False).alias("blank"), F.array().cast("array<string>").alias("out"))

    def step(state: Column, line: Column) -> Column:
        begins, ends = line.rlike("(?i)\\A\\\\begin\\{tabular\\*?"), line.rlike("(?i)\\A\\\\end\\{tabular\\*?")
        blank = T.is_blank(line)
        body = state["inside"] & ~begins & ~ends
        skip = body & blank & state["blank"]
        spec = F.regexp_extract(line, f"\\{{([^{{}}]*)\\}}{T.SPACE}*\\z", 1)
        columns = F.when(begins, column_count(spec)).when(ends, F.lit(0)).otherwise(state["columns"]).cast("long")
        comment = T.strip(line).startswith("%")
        text = F.when(body & ~blank & ~comment, repair_row(line, state["columns"])).otherwise(line)
        return F.struct(
            ((state["inside"] & ~ends) | begins).alias("inside"), columns.alias("columns"),
            F.when(body & (blank | comment), state["blank"] | blank).otherwise(F.lit(False)).alias("blank"),
            F.when(skip, state["out"]).otherwise(F.array_append(state["out"], text)).alias("out"))

    def finish(state: Column) -> Column:
        return F.when(state["inside"], F.array_append(state["out"], F.lit("\\end{tabular}"))).otherwise(state["out"])

    repaired = T.join_lines(F.aggregate(T.split_newlines(value), start, step, finish))
    return F.when(value.rlike("(?im)^\\\\begin\\{tabular\\*?"), repaired).otherwise(value)


# ---- the whole cleaning chain ------------------------------------------------------------------------------------

# Leftovers to remove at the end.
LEFTOVERS = [
    "\\[TWO_COLUMN_PAGE\\]", "\\\\begin\\{multicols\\}\\{\\d+\\}\\s*", "\\\\end\\{multicols\\}\\s*",
    "\\\\vspace(?:\\*?)\\{[^{}]*\\}\\s*", "\\\\(?:newpage|pagebreak|clearpage)\\s*",
]


def _open_fences(value: Column) -> Column:
    value = F.regexp_replace(T.strip(value), "(?imd)^```(?:latex)?", "")
    value = F.regexp_replace(value, "(?md)```$", "")
    value = F.replace(F.replace(value, F.lit("\\ begin"), F.lit("\\begin")), F.lit("\\ end"), F.lit("\\end"))
    return F.regexp_replace(value, "\\\\(begin|end)\\s+\\{", "\\\\$1{")


def _plain_references(value: Column) -> Column:
    return F.regexp_replace(value, "\\\\eqref\\{([^}]+)\\}", "(\\\\ref{$1})")


def _fix_transposes(value: Column) -> Column:
    for _, pattern, replacement in TRANSPOSE_RULES.values():
        value = F.regexp_replace(value, pattern, replacement)
    return value


def _drop_leftovers(value: Column) -> Column:
    for pattern in LEFTOVERS:
        value = F.regexp_replace(value, pattern, "")
    return T.strip(T.squeeze_blank_lines(value))


# The order matters: later steps rely on what earlier ones repaired.
CLEANING_STEPS = [
    _open_fences, repair_display, _plain_references, _fix_transposes, align_to_aligned, repair_tabular_blocks,
    fill_empty_tables, repair_table_lines, drop_page_numbers, drop_rules, _drop_leftovers,
]


# ---- documents ---------------------------------------------------------------------------------------------------

# Template classes, packages, page markers.
BASE_PACKAGES = ["\\usepackage{amsmath,amssymb,amsthm}", "\\usepackage{graphicx}", "\\usepackage{hyperref}"]
CHINESE_PACKAGE = "\\usepackage{xeCJK}"
ALGORITHM_PACKAGES = ["\\usepackage{algorithm}", "\\usepackage{algpseudocode}"]
DOCUMENT_CLASSES = {
    "report": "\\documentclass[12pt]{report}", "book": "\\documentclass[12pt]{book}", "beamer": "\\documentclass{beamer}",
}
DEFAULT_CLASS = "\\documentclass[12pt]{article}"
CHINESE_TEMPLATE = "cn-article"
PAGE_MARKER = "(?md)^\\s*%\\s*=+\\s*第\\s*(\\d+)\\s*页\\s*=+\\s*$"


def to_frames(body: Column) -> Column:
    """One beamer frame per page block."""
    blocks = F.filter(F.transform(F.split(body, PAGE_MARKER), T.strip), lambda b: b != "")
    blocks = T.let(blocks, lambda found: F.when(F.size(found) == 0, F.array(body)).otherwise(found))
    frames = F.transform(blocks, lambda b, i: F.concat(
        F.lit("\\begin{frame}[fragile]\n\\frametitle{第 "), (i + 1).cast("string"), F.lit(" 页}\n"), b, F.lit("\n\\end{frame}\n")))
    return F.when(body.contains("\\begin{frame}") | (body == ""), body).otherwise(T.strip(T.join_lines(frames)))


def wrap_document(body: Column, template: Column, chinese: Column) -> Column:
    """Put a cleaned body into its template."""
    template = F.lower(F.coalesce(template, F.lit("article")))
    document_class = F.lit(DEFAULT_CLASS)
    for name, line in DOCUMENT_CLASSES.items():
        document_class = F.when(template == name, line).otherwise(document_class)
    # The Chinese template adds its package after the algorithm packages.
    uses_algorithm = body.rlike("\\\\begin\\{algorithm(?:ic)?\\}")
    late_chinese = (template == CHINESE_TEMPLATE) & ~chinese
    content = F.when(template == "beamer", to_frames(T.strip(body))).otherwise(body)
    return F.concat_ws(
        "\n", document_class, *[F.lit(p) for p in BASE_PACKAGES], F.when(chinese, F.lit(CHINESE_PACKAGE)),
        *[F.when(uses_algorithm, F.lit(p)) for p in ALGORITHM_PACKAGES], F.when(late_chinese, F.lit(CHINESE_PACKAGE)),
        F.lit(""), F.lit("\\begin{document}"), F.lit(""), content, F.lit(""), F.lit("\\end{document}"))
