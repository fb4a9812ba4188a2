"""Example-based checks of the column functions and small operators."""

from pyspark.sql import functions as F

from quire.functions import latex as L
from quire.functions import lines as P
from quire.functions import quality as Q
from quire.functions import text as T
from quire.operators import cache, chunks, margins, naming, pagetext, ranges, responses, structure, tex, usage


def test_parse_page_ranges(spark):
    cases = {
        "1-3,5,7-9": ([0, 1, 2, 4, 6, 7, 8], None), "1-3,2,3,4": ([0, 1, 2, 3], None), "": (None, None), " , ": (None, None),
        "5-3": (None, "reversed"), "1-2-3": (None, "bad_range"), "1-": (None, "bad_range"), "1,a,3": (None, "bad_page"),
        "0": (None, "not_positive"), "-1": (None, "not_positive"), "1-0": (None, "not_positive"), "5--3": (None, "not_positive"),
        "1-5001": (None, "range_too_long"), "2-5001": (list(range(1, 5001)), None), "5001": (None, "out_of_range"),
        "99999999999999999999999": (None, "out_of_range"),
    }
    df = spark.createDataFrame([(k,) for k in cases], "expr string")
    got = {r.expr: (r.pages, r.error) for r in ranges.parse_page_ranges(df).collect()}
    assert got == cases
    limited = ranges.parse_page_ranges(spark.createDataFrame([("100", 50)], "expr string, n int"), max_pages=F.col("n"))
    assert limited.first().error == "out_of_range"


def test_compress_page_ranges(apply):
    values = ["1,2,3,5", "1,2,3,4,7,8,9,21,22,23,24", "all", "*", "1-3", "7", "x", "3,1,2", "1,1,2"]
    want = ["1-3,5", "1-4,7-9,21-24", "全部", "全部", "1-3", "7", "x", "1-3", "1,1-2"]
    assert apply(ranges.compress_page_ranges, values) == want


def test_pagination_lines(apply):
    cases = [("5", True), ("10", True), ("3", False), ("5/10", True), ("3/10", False), ("第 5 页", True), ("Page 5 of 10", True), ("p. 7", True),
             ("2. 线性方程组求解", True), ("第1章 引言", True), ("线性方程 2.4", True), ("8    2. 线性方程组求解", True), ("- 5 -", False),
             ("Chapter 1 Introduction", True), ("This is a plain sentence about 5 things.", False), ("", False)]
    got = apply(lambda s: P.is_pagination(s, F.lit(4), F.lit(10)), [c[0] for c in cases])
    assert got == [c[1] for c in cases]


def test_headings(apply):
    values = ["Chapter 1 Foo", "2.1.3 Methods", "1. Introduction", "References", "第 一 章 引言", "x = 1 + 2", "plain text here"]
    assert apply(P.is_heading, values) == [True, True, True, True, True, False, False]
    levels = apply(structure.heading_level, ["Chapter 1", "Section 2.1", "2.1.3 Methods", "1. Introduction", "Big"], [20, 14, 12, 13, 25], [10] * 5)
    assert levels == [1, 2, 3, 2, 1]


def test_quality(apply):
    long = "This is a normal English sentence with enough readable characters."
    good, bad, empty = apply(Q.text_quality, [long, "■□■□■□■□■□■□■□■□", ""])
    assert good > 0.5 > bad and empty == 0
    scores = apply(Q.vision_quality, [long, "aaaaaaaaaaaa bbbb", " ", "(cid:3) text"])
    assert scores[2] == 0 and 0 < scores[1] < scores[0] <= 0.92 and scores[3] < scores[0]
    assert apply(Q.content_type, ["", "plain words only", "x^2+y=z"]) == ["unknown", "text", "formula"]


def test_normalize(apply):
    assert apply(pagetext.normalized, ["Body (cid:4) text", "a \r\n  b\r c "]) == ["Body  text", "a\nb\nc"]
    assert apply(pagetext.normalized, ["  a \n   b  \n"], ["code"]) == ["  a\n   b"]


def test_split_lines(apply):
    got = apply(T.split_lines, ["a\nb\n", "a\r\nb\x0bc\u2028d", "\n\na"])
    assert got == [["a", "b"], ["a", "b", "c", "d"], ["", "", "a"]]


def test_transpose_rules(spark):
    cases = {"W.T": "W^{\\mathsf{T}}", "W T": "W^{\\mathsf{T}}", "A.t": "A^{\\mathsf{T}}", "W TA": "W TA", "W T.": "W T.", "W.H": "W^{\\dagger}",
             "W\\top": "W^{\\top}", "W^T": "W^{T}"}
    df = spark.createDataFrame([("b", i, k) for i, k in enumerate(cases)], "book string, page_num int, text string")
    got = [r.text for r in pagetext.math_rewrite(df, "transpose").orderBy("page_num").collect()]
    assert got == list(cases.values())


def test_notation_and_extract_rules(spark):
    cases = {"x^2": "x^{2}", "a \\le b": "a \\leq b", "alpha-beta": "alpha-beta", "line": "line", "alpha": "\\alpha", "\\alpha": "\\alpha", "a le b": "a \\leq b"}
    df = spark.createDataFrame([("b", i, k) for i, k in enumerate(cases)], "book string, page_num int, text string")
    assert [r.text for r in pagetext.math_rewrite(df, "notation").orderBy("page_num").collect()] == list(cases.values())
    tagged = spark.createDataFrame([("b", 0, "E \\tag{1.15} x^12")], "book string, page_num int, text string")
    row = pagetext.math_rewrite(tagged, "extract").first()
    assert row.text == "E \\qquad (1.15) x^{12}" and row.n_tag == 1 and row.n_power == 1


def test_escape(apply):
    assert apply(L.escape_tex, ["100% of x_y & z", "a\\b{c}~^"]) == ["100\\% of x\\_y \\& z", "a\\textbackslash{}b\\{c\\}\\textasciitilde{}\\textasciicircum{}"]
    assert apply(L.escape_tex_keep_math, ["cost_1 \\(a_1\\) & \\(open"]) == ["cost\\_1 \\(a_1\\) \\& \\textbackslash{}(open"]


def test_math_predicate(apply):
    cases = [("\\frac{a}{b}", True), ("$x$", True), ("the value \\(A\\) is here", False), ("\\(x = 1\\)", True), ("√", False), ("√ √", False),
             ("x = y + 1", True), ("The result equals five when x = y holds always", False), ("x_i", True), ("α + β = 1", True), ("words only", False)]
    assert apply(P.is_math, [c[0] for c in cases]) == [c[1] for c in cases]


def test_repair_display(apply):
    values = ["\\[\\[x = y\\]\\]", "\\textbackslash{}] tail", "a \\[ √ \\] b", "open \\[ x = 1", "stray \\] x",
              "\\[ this is a long piece of ordinary explanatory prose that was wrapped by mistake here \\]"]
    got = apply(L.repair_display, values)
    assert got[0] == "\\[\nx = y\n\\]" and got[1] == " tail" and got[2] == "a  b" and got[3] == "open  x = 1" and got[4] == "stray  x"
    assert got[5].startswith("this is a long piece")


def test_align(apply):
    got = apply(L.align_to_aligned, ["\\begin{align}\na = b\nc &= d\n\\end{align}", "$$\\begin{align*}x\\end{align*}$$", "\\begin{aligned}x\\end{aligned}",
                                     "\\[\\begin{aligned}x\\end{aligned}\\]", "\\begin{equation}\n\\begin{aligned}x\\end{aligned}\n\\end{equation}"])
    assert got[0] == "\\[\n\\begin{aligned}\na &= b \\\\\nc &= d\n\\end{aligned}\n\\]"
    assert got[1] == "\\[\n\\begin{aligned}\nx\n\\end{aligned}\n\\]"
    assert got[2] == "\n\\[\n\\begin{aligned}x\\end{aligned}\n\\]\n"
    assert got[3] == "\\[\\begin{aligned}x\\end{aligned}\\]" and "\\[" not in got[4]


def test_tables(apply, spark):
    begin, end = "\\begin{tabular}{|c|c|c|}", "\\end{tabular}"
    fixed = apply(L.repair_tabular_blocks, [f"{begin}\nA & B \\\\\n1 & 2 & 3 & 4 \\\\\n\\hline\nu & v & w\n{end}"])[0]
    assert fixed == f"{begin}\nA & B & -- \\\\\n1 & 2 & 3 \\& 4 \\\\\n\\hline\nu & v & w \\\\\n{end}"
    closed = apply(L.repair_table_lines, [f"x\n{begin}\n\n\na & b"])[0]
    assert closed == f"x\n{begin}\n\na & b & -- \\\\\n{end}"
    assert apply(L.fill_empty_tables, [f"{begin}{end}"])[0] == f"{begin}\n{' & '.join([' ' * 8] * 3)}\n{end}"
    assert apply(L.column_count, ["|c|l|r|", "p{3cm}X", "@{}c@{}c", ""]) == [3, 2, 2, 0]
    text = apply(structure.tabular_from_context, ["[TABLE 1] cols=2\nROW 1: a_1 | \nROW 2: x", "nothing"])
    assert text[0] == "\\begin{tabular}{|l|l|}\n\\hline\na\\_1 & -- \\\\\n\\hline\nx & -- \\\\\n\\hline\n\\end{tabular}" and text[1] == ""


def test_sanitize_is_idempotent(spark):
    pages = ["```latex\n\\ begin{equation}\nx\n\\end {equation}\n```", "\\[\\[ a = b \\]\\]\n19\n\\hrule\n\\eqref{k} \\newpage W.T\n\n\n\nend",
             "% ===== 第 2 页 =====\n\\begin{tabular}{cc}\n\\hline\na\\\\\n\\end{tabular}"]
    df = spark.createDataFrame([("b", i, p) for i, p in enumerate(pages)], "book string, page_num int, tex string")
    once = tex.sanitize_tex(df)
    first = [r.tex for r in once.orderBy("page_num").collect()]
    assert first == [r.tex for r in tex.sanitize_tex(once).orderBy("page_num").collect()]
    assert first[0] == "\\begin{equation}\nx\n\\end{equation}"
    assert "19" not in first[1] and "hrule" not in first[1] and "(\\ref{k})" in first[1] and "W^{\\mathsf{T}}" in first[1] and "\n\n\n" not in first[1]
    assert "第 2 页" in first[2] and "\\hline" in first[2]


def test_diagnostics(spark):
    pages = ["\\[\\[x = y\\]\\]", "a\n\\[ 这里是一段很长的中文说明文字而不是公式内容请改为正文段落 \\]", "\\( a", "ok"]
    df = spark.createDataFrame([("b", i, p) for i, p in enumerate(pages)], "book string, page_num int, tex string")
    got = {(r.page_num, r.code, r.line) for r in tex.page_diagnostics(df).collect()}
    assert got == {(0, "nested_display_math", 1), (1, "prose_in_display_math", 2), (2, "unbalanced_inline_math", 1)}


def test_duplicate_headers(apply):
    long = "y" * 100
    got = apply(structure.mark_duplicate_headers, ["Head\nHead\nbody\nHead\nHead", f"{long}\n{long}", "a\n\na"])
    assert got[0] == "Head\n[DUPLICATE_HEADER]Head[/DUPLICATE_HEADER]\nbody\nHead" and got[1] == f"{long}\n{long}" and got[2] == "a\n\na"


def test_batch_response(spark):
    answers = [("b", 0, "[PAGE 1]\n[DUPLICATE_HEADER]x[/DUPLICATE_HEADER]one\n[PAGE 2]\ntwo\n[PAGE 3] \n[PAGE 9]\nmade up"), ("b", 1, "no marker\n\nat all")]
    wanted = [("b", p, p // 4) for p in range(8)]
    got = structure.parse_batch_response(spark.createDataFrame(answers, "book string, chunk bigint, content string"),
                                         spark.createDataFrame(wanted, "book string, page_num int, chunk bigint"))
    assert sorted((r.page_num, r.text) for r in got.collect()) == [(0, "one"), (1, "two")]


def test_pick_version(spark):
    judges = [('{"winner": 1}', "v1"), ('{"winner": 2}', "v2"), ("not json", "v1"), ('```json\n{"winner": 2}\n```', "v2"), ('x "winner": 2', "v2"), (None, "v1"), ('{"a": 1}', "v1")]
    df = spark.createDataFrame([(i, "v1", "v2", "o", j) for i, (j, _) in enumerate(judges)], "doc_id int, v1 string, v2 string, original string, judge string")
    assert [r.text for r in responses.pick_version(df).orderBy("doc_id").collect()] == [w for _, w in judges]
    lone = spark.createDataFrame([(0, "", "v2", "o", None), (1, "", " ", "o", None)], "doc_id int, v1 string, v2 string, original string, judge string")
    assert [r.text for r in responses.pick_version(lone).orderBy("doc_id").collect()] == ["v2", "o"]


def test_long_formula(apply):
    formula = " + ".join(f"a_{{{i}}}" for i in range(44))
    shown = apply(structure.render_formula, [formula, "x = 1", "√"])
    rows = shown[0].split("\n")
    assert rows[0] == "\\[" and rows[1] == "\\begin{aligned}" and rows[2].startswith("& a_{0}") and rows[3].startswith("&\\quad ") and rows[-1] == "\\]"
    assert "".join(r.replace("&\\quad ", "").replace("& ", "").replace(" \\\\", "") for r in rows[2:-2]).replace(" ", "") == formula.replace(" ", "")
    assert shown[1] == "\\[\nx = 1\n\\]" and shown[2] == ""


def test_page_blocks(spark):
    text = "1 Introduction\n100% of x_y\nmore text\n\nH(t) = t^3 +\ns^2 + w^2\nplain tail [STRUCTURED_TABLE_CONTEXT]\nROW 1: a | b"
    df = spark.createDataFrame([("b", 0, text), ("b", 1, "")], "book string, page_num int, text string")
    got = {r.page_num: r.latex for r in structure.page_blocks(df).collect()}
    assert got[0] == ("\\section*{1 Introduction}\n\n100\\% of x\\_y more text\n\n\\[\nH(t) = t^3 + s^2 + w^2\n\\]\n\nplain tail\n\n"
                      "\\begin{tabular}{|l|l|}\n\\hline\na & b \\\\\n\\hline\n\\end{tabular}")
    assert got[1] == ""


def test_usage_cost(spark):
    use = spark.createDataFrame([(1, "m", 500_000, 250_000), (2, "unknown", 5, 5), (3, "m", -9, 0)], "id int, model string, prompt_tokens bigint, completion_tokens bigint")
    price = spark.createDataFrame([("m", 2.0, 4.0, "CNY")], "model string, input_per_million double, output_per_million double, currency string")
    got = {r.id: (r.input_cost, r.output_cost, r.total_cost) for r in usage.usage_cost(use, price).collect()}
    assert got == {1: (1.0, 1.0, 2.0), 2: (None, None, None), 3: (0.0, 0.0, 0.0)}


def test_log_errors(spark):
    logs = ["C:/tmp/document.tex:12: Undefined control\n sequence.\nl.12 \\foo", "! Extra }, or forgotten $.\nl.8 x", "a.tex:9: Fatal error occurred\n! Emergency stop.",
            "! first\n! second\nl.3 y"]
    got = structure.compile_log_errors(spark.createDataFrame(list(enumerate(logs)), "log_id int, log string")).collect()
    assert sorted((r.log_id, r.error_no, r.line, r.message) for r in got if r.line) == [
        (0, 1, 12, "Undefined controlsequence."), (1, 1, 8, "Extra }, or forgotten $."), (3, 2, 3, "second")]
    assert sorted((r.log_id, r.message) for r in got if r.line is None) == [(2, "Emergency stop."), (3, "first")]


def test_cache_keys(apply):
    key = apply(lambda t: cache.cache_key(t, F.lit("3,1,2"), F.lit(True)), ["x"])[0]
    assert key.endswith("_p1-2-3_tr") and apply(lambda t: cache.cache_key(t, F.lit(None).cast("string"), F.lit(False)), ["x"])[0] == key[:32]


def test_safe_filename(apply):
    got = apply(naming.safe_filename, ["a/b:c.pdf", " ..x. .pdf", "论文 1.pdf", "", "noext", "." , "n" * 300 + ".pdf", "a.b.c"])
    assert got == ["a_b_c.pdf", "x.pdf", "论文 1.pdf", "unnamed", "noext", "unnamed", "n" * 200 + ".pdf", "a.b.c"]


def test_references(apply, spark):
    texts = ["body\nReferences\n[1] A", "p\n" * 8 + "1. Smith, J. 1999\n2. Lee, K. 2004\n\n3. Roy, P. 2010\n4. Kim, D. 2015",
             "long body text here\n" * 6 + "\n".join(f"[{i}] r" for i in range(1, 7)) + "\ntail words end", "nothing"]
    df = spark.createDataFrame([("b", i, t) for i, t in enumerate(texts)], "book string, page_num int, text string")
    got = {r.page_num: (r.rule, r.main, r.references) for r in structure.split_references(df).collect()}
    assert got[0] == ("heading", "body", "References\n[1] A")
    assert got[1][0] == "tail" and got[1][2].startswith("1. Smith") and got[2][0] == "brackets" and got[2][2].startswith("[1] r")
    assert got[3] == ("", "nothing", "")


def test_margins(spark):
    pages = [("b", i, f"Journal of Things {i}\nbody {'x' * i} words\nmore\nother {'y' * i}\nlast {'z' * i}\n{i + 1}") for i in range(4)]
    df = spark.createDataFrame(pages, "book string, page_num int, text string")
    keys = {r.margin_key: r.n_pages for r in margins.repeated_margin_lines(df).collect()}
    assert keys["journal of things #"] == 4 and keys["#"] == 4
    cleaned = [r.text for r in margins.strip_repeated_margins(df).orderBy("page_num").collect()]
    assert all("Journal" not in t and not t.rstrip()[-1].isdigit() for t in cleaned) and "body x words" in cleaned[1]


def test_upsert(spark):
    old = spark.createDataFrame([("b", 0, "% ===== 第 1 页 =====\nA"), ("b", 1, "% 第 2 页转换失败\n")], "book string, page_num int, block string")
    new = spark.createDataFrame([("b", 1, "% ===== 第 2 页 =====\nnew  \n"), ("b", 7, "x")], "book string, page_num int, block string")
    got = {r.page_num: (r.status, r.block) for r in chunks.upsert_page_block(old, new).collect()}
    assert got == {0: ("kept", "% ===== 第 1 页 =====\nA"), 1: ("replaced", "% ===== 第 2 页 =====\nnew\n\n"), 7: ("missing", None)}


def test_algorithm_context(apply):
    got = apply(pagetext.has_algorithm, ["Algorithm 1 Search\nInput: x\nwhile y do", "1. first item\n2. second item", "算法 2\n输出 y", "Algorithm 3"])
    assert got == [True, False, True, False]
