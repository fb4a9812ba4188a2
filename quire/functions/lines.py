"""Predicates on one line of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import text as T

S, W, WB, WE = T.SPACE, T.WORD, T.WORD_START, T.WORD_END

# Page-number notations and running titles.
CN_PAGE = f"(?i)\\A第{S}*[0-9]{{1,4}}{S}*页(?:{S}*(?:/|共){S}*[0-9]{{1,4}}{S}*页?)?\\z"
EN_PAGE = f"(?i)\\A(?:page|p\\.){S}*[0-9]{{1,4}}(?:{S}*(?:/|of){S}*[0-9]{{1,4}})?\\z"
FRACTION = f"\\A([0-9]{{1,4}}){S}*/{S}*([0-9]{{1,4}})\\z"
RUNNING_TITLES = [
    f"\\A[0-9]{{1,2}}\\.{S}*[\\u4e00-\\u9fff]{{2,20}}\\z",
    f"\\A第{S}*[0-9]+{S}*章{S}*[\\u4e00-\\u9fff]{{2,20}}\\z",
    f"\\A[\\u4e00-\\u9fff]{{2,12}}{S}+[0-9]+\\.[0-9]+(?:{S}+[\\u4e00-\\u9fff]{{1,12}})?\\z",
    f"\\A{S}*[0-9]+{S}+[0-9]+(?:\\.[0-9]+)?\\.?{S}*[\\u4e00-\\u9fff]{{1,20}}\\z",
    f"(?i:\\A(?:chapter|section){S}+[0-9]+(?:\\.[0-9]+)*{S}+.{{2,40}}\\z)",
]
# Headings in extracted text, and headings in text to be converted.
HEADINGS = [
    f"\\A(?:Chapter|CHAPTER|Section|SECTION|Part|PART){S}+[0-9IVX]+",
    "\\A(?:Abstract|ABSTRACT|Introduction|INTRODUCTION|Conclusion|CONCLUSION|References|REFERENCES|Bibliography|Acknowledgement|Appendix)" + WE,
    f"\\A[0-9]+(?:\\.[0-9]+){{0,3}}\\.?{S}+[A-Z](?:{W}|{S}|[\\-:,()]){{2,60}}\\z",
    f"\\A[0-9]+\\.{S}+[A-Z][a-zA-Z]+",
    f"\\A第{S}*[\\u4e00-\\u9fff0-9]+{S}*[章节]{S}*[\\u4e00-\\u9fff]*",
    "\\A(?:摘要|引言|前言|背景|相关工作|方法|实验|结果|讨论|结论|总结|参考文献|致谢|附录)" + WE,
]
TEXT_HEADINGS = [
    f"(?i:\\A(?:chapter|section){S}+[0-9]+(?:{S}|[:.\\-])+{T.NOT_SPACE}+)",
    f"\\A[0-9]+(?:\\.[0-9]+){{0,3}}\\.?{S}+{T.NOT_SPACE}+",
    f"(?i:\\A(?:摘要|引言|结论|参考文献|bibliography|references){WE})",
]
TEXT_HEADING_CHARS = 90
# Signs of a formula on a line.
FORMULAS = [
    "\\$[^$]+\\$", "\\\\\\([^)]+\\\\\\)", "\\\\\\[[^\\]]+\\\\\\]", "\\\\begin\\{equation", "\\\\begin\\{align",
    f"\\\\frac{WE}", f"\\\\(?:sum|int|prod){WE}", f"\\\\(?:partial|nabla){WE}",
    "\\\\(?:alpha|beta|gamma|theta|lambda|mu|sigma|omega)", "\\^[_a-zA-Z0-9{(]", "[_a-zA-Z0-9}]\\^",
]
# Looking for two spaces first lets most positions fail at once.
TABLE_LINE = f"(?={S}{{2}})(?<={T.NOT_SPACE}){S}{{2,}}{T.NOT_SPACE}{S}{{2,}}{T.NOT_SPACE}"
# What makes a line mathematical.
WHOLE_INLINE = "\\A\\\\\\([^\\r\\n]+?\\\\\\)\\z"
TEX_SIGNAL = "\\\\[a-zA-Z]+|\\\\\\[|\\\\begin\\{|\\$[^$]+\\$"
INLINE = "\\\\\\([^\\r\\n]*?\\\\\\)"
LONE_SYMBOLS = f"\\A(?:[√∑∫∏±∓≈≠≤≥=+\\-*/·.,:;()\\[\\]{{}}|]|{S})+\\z"
GREEK_OR_SIGN = "[∑∫√≤≥≈∞α-ωΑ-Ω]"
LONE_VARIABLE = "\\A[A-Za-z](?:_[A-Za-z0-9]+)?(?:\\^[A-Za-z0-9{}+\\-]+)?\\z"
EQUATION = "\\A[A-Za-z0-9_{}().,+\\-*/^ ]+\\s*(?:=|<=|>=|<|>)\\s*[A-Za-z0-9_{}().,+\\-*/^ ]+\\z"
MAX_WORD_TERMS = 2
LONG_TERM = "[A-Za-z]{17,}"
# A formula that goes on, and how its continuation may start.
UNFINISHED_END = "(?:[=+*/^_({\\[]|\\\\(?:frac|sum|int|prod|left))\\s*\\z"
UNFINISHED_PAGE_END = "(?:[=+*/^_({\\[]|\\\\(?:frac|sum|int|prod|left|begin\\{[^}]+\\}))\\s*\\z"
CONTINUATION = "\\A(?:[+*/=,)}\\]]|\\\\[A-Za-z]+|[A-Za-z0-9({\\[])"
PAGE_CONTINUATION = "\\A(?:[+*/=,)\\]}]|\\\\frac|\\\\sum|\\\\int|\\\\prod|\\\\sqrt|\\\\right|\\\\end\\{|[A-Za-z]\\s*(?:[_^=]|\\())"


def is_pagination(line: Column, page_num: Column, total_pages: Column) -> Column:
    """Is this line page furniture: a page number in some notation, or a running title?"""
    return T.let(T.strip(line), lambda s: _is_pagination(s, page_num + 1, total_pages))


def _is_pagination(s: Column, current: Column, total_pages: Column) -> Column:
    number = F.when(s.rlike("\\A[0-9]{1,4}\\z"), s).try_cast("int")
    # A cast that fails builds an exception inside, so only what may be a fraction is cast.
    left, right = (F.when(s.contains("/"), F.regexp_extract(s, FRACTION, group)).try_cast("int") for group in (1, 2))
    lone = (number == current) | ((total_pages > 0) & (number == total_pages))
    fraction = (left == current) & ((total_pages <= 0) | (right == total_pages))
    numbered = F.coalesce(lone, F.lit(False)) | F.coalesce(fraction, F.lit(False))
    return numbered | T.matches_any(s, [CN_PAGE, EN_PAGE, *RUNNING_TITLES])


def is_heading(line: Column) -> Column:
    return T.matches_any(line, HEADINGS)


def is_text_heading(line: Column) -> Column:
    return T.let(T.strip(line), lambda s: (
        (F.length(s) <= TEXT_HEADING_CHARS) & ~s.rlike("[.,;:]\\z") & T.matches_any(s, TEXT_HEADINGS)))


def has_formula(line: Column) -> Column:
    return T.matches_any(line, FORMULAS)


def is_math(line: Column) -> Column:
    """Mathematics or prose?  Commands decide first; a sentence around a short formula stays prose."""
    return T.let(T.strip(line), _is_math)


def _is_math(s: Column) -> Column:
    signs = T.count_matches(s, "[A-Za-z0-9]")
    symbolic = s.rlike(GREEK_OR_SIGN) & s.rlike("[A-Za-z0-9_^=+\\-*/]") & ((signs >= 2) | s.contains("="))

    def equation(compact: Column) -> Column:
        few_words = T.count_matches(compact, "[A-Za-z]{2,}") <= MAX_WORD_TERMS
        return compact.rlike(LONE_VARIABLE) | (compact.rlike(EQUATION) & few_words & ~compact.rlike(LONG_TERM) & ~compact.rlike("[;:!?]"))

    return (
        F.when(s == "", False).when(s.rlike(WHOLE_INLINE) | s.rlike(TEX_SIGNAL), True).when(s.rlike(INLINE), False)
        .when(s.rlike(LONE_SYMBOLS), False).when(symbolic, True).otherwise(T.let(F.regexp_replace(s, f"{S}+", " "), equation))
    )


def opens_more(line: Column) -> Column:
    """More opening than closing brackets of some kind."""
    return (
        (T.count_char(line, "{") > T.count_char(line, "}")) | (T.count_char(line, "(") > T.count_char(line, ")"))
        | (T.count_char(line, "[") > T.count_char(line, "]"))
    )


def continues(previous: Column, following: Column) -> Column:
    """Is ``following`` the wrapped rest of the formula on ``previous``?  Both trimmed; NULL counts as no."""
    joined = (previous != "") & (following != "") & (previous.rlike(UNFINISHED_END) | opens_more(previous)) & following.rlike(CONTINUATION)
    return F.coalesce(joined, F.lit(False))
