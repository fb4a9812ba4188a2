"""Windowed and blocked forms against plain sequential ones on random cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quire.operators import chunks, filling, history, naming, structure, tasks, tex, usage
from quire.operators.blocks import number_rows, with_running
from quire.sources.corpus import scan_corpus


def test_running_values(spark):
    rng = random.Random(1)
    rows = []
    for g in range(6):
        keys = rng.sample(range(200 if g else 4000), 60 if g else 900)  # group 0 holds most rows
        rows += [(g, k, rng.randint(-5, 9) if rng.random() < 0.8 else None) for k in keys]
    df = spark.createDataFrame(rows, "g int, k bigint, v bigint")
    for width, levels, exclusive in [(7, 1, False), (5, 2, True), (4096, 1, True), (3, 3, False)]:
        got = with_running(df, ["g"], "k", {"s": (F.col("v"), F.sum), "hi": (F.col("v"), F.max), "lo": (F.col("v"), F.min)}, width, exclusive, levels)
        got = {(r.g, r.k): (r.s, r.hi, r.lo) for r in got.collect()}
        want = {}
        for g in range(6):
            seen = []
            for _, k, v in sorted(r for r in rows if r[0] == g):
                if not exclusive and v is not None:
                    seen.append(v)
                want[g, k] = (sum(seen), max(seen), min(seen)) if seen else (None, None, None)
                if exclusive and v is not None:
                    seen.append(v)
        assert got == want
    numbered = {(r.g, r.k): r.n for r in number_rows(df, ["g"], "k", "n", 11).collect()}
    for g in range(6):
        ordered = sorted(r[1] for r in rows if r[0] == g)
        assert [numbered[g, k] for k in ordered] == list(range(1, len(ordered) + 1))


def test_pages_of_a_dominant_book(spark):
    docs = [(i * 3, f"text {i}", "en", "big" if i % 3 else f"s{i % 7}") for i in range(500)]
    pages = scan_corpus(spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string"), width=16)
    got = {r.doc_id: (r.book, r.page_num) for r in pages.collect()}
    count = {}
    for doc_id, _, _, source in docs:
        assert got[doc_id] == (source, count.get(source, 0))
        count[source] = count.get(source, 0) + 1


def _stitch(pages):
    """Boundary by boundary, moving lines as they go."""
    texts, touched = dict(pages), set()

    def content(t):
        return [i for i, line in enumerate(t.split("\n")) if line.strip() and not (line.strip()[0] == "[" and line.strip()[-1] == "]")]

    for p in sorted(texts):
        if p + 1 not in texts:
            continue
        a, b = content(texts[p]), content(texts[p + 1])
        if not a or not b:
            continue
        left, right = texts[p].split("\n"), texts[p + 1].split("\n")
        tail, head = left[a[-1]].strip(), right[b[0]].strip()
        open_end = bool(re.search(r"[=+]$", tail)) or tail.count("(") > tail.count(")")
        if open_end and re.match(r"[+=)]|[A-Za-z]\s*[_^=(]", head):
            left[a[-1]] = f"{tail} {head}"
            del right[b[0]]
            texts[p], texts[p + 1] = "\n".join(left).strip(), "\n".join(right).strip()
            touched |= {p, p + 1}
    return {p: (texts[p], p in touched) for p in texts}


def test_stitching_chains(spark):
    rng = random.Random(2)
    lines = ["x = 1 +", "y = 2 +", "+ z =", "plain words", "f(x", ") end", "[note]", ""]
    cases = {f"b{c}": [(p, "\n".join(rng.choice(lines) for _ in range(rng.choice([1, 1, 1, 2, 3])))) for p in range(12) if rng.random() < 0.93] for c in range(150)}
    df = spark.createDataFrame([(b, p, t) for b, ps in cases.items() for p, t in ps], "book string, page_num int, text string")
    got = {(r.book, r.page_num): (r.text, r.stitched) for r in structure.stitch_cross_page_formulas(df, width=5).collect()}
    for book, pages in cases.items():
        for p, (text, touched) in _stitch(pages).items():
            have = got[book, p]
            assert have[1] == touched and (have[0] == text if touched else True), (book, p)


def test_chapter_fold(spark):
    rng = random.Random(3)
    rows, want = [], set()
    for c in range(120):
        kept = []
        for p in range(14):
            heads = [(rng.choice(["Chapter 1 One", "Chapter 2 Two"]), float(rng.choice([14, 15, 16]))) for _ in range(rng.choice([0, 1, 1, 1, 2, 3]))]
            for i, (title, size) in enumerate(heads):
                rows.append((f"b{c}", p, i, title, size, 100.0 + i))
                if kept and kept[-1][1] == title and p - kept[-1][0] <= 1:
                    if size > kept[-1][2]:
                        kept[-1] = (p, title, size)
                else:
                    kept.append((p, title, size))
            rows += [(f"b{c}", p, 10 + i, "body", 10.0, 300.0 + i) for i in range(5)]
        want |= {(f"b{c}", n, *k) for n, k in enumerate(kept)}
    df = spark.createDataFrame(rows, "book string, page_num int, line_no int, text string, size double, y0 double")
    found = structure.chapter_boundaries(df, width=4).collect()
    got = sorted((r.book, r.page_num, r.title, r.font_size) for r in found)
    assert got == sorted((b, p, t, s) for b, _, p, t, s in want)


def _stack_checks(text):
    braces, missing = 0, 0
    for ch in re.sub(r"%[^\n]*", "", text):
        if ch == "{":
            braces += 1
        elif ch == "}" and braces:
            braces -= 1
        elif ch == "}":
            missing += 1
    stack, env = [], []
    for m in re.finditer(r"%[^\n]*|\\(begin|end)\{([^}]*)\}?", text):
        if m.group(0)[0] == "%":
            continue
        name, known = m.group(2), m.group(2).rstrip("*") in tex.KNOWN_ENVIRONMENTS
        if m.group(1) == "begin":
            stack += [name] if known else []
        elif stack:
            env += ["mismatch"] if stack.pop() != name else []
        elif known:
            env.append("extra_end")
    env += ["unclosed"] * len(stack)
    open_, wrong, extra = [], 0, 0
    for m in re.finditer(r"%[^\n]*|\\[a-zA-Z][^ \n{}]*|\\[()\[\]]", text):
        t = m.group(0)
        if t in ("\\(", "\\["):
            open_.append(t)
        elif t in ("\\)", "\\]"):
            if open_ and open_[-1] == {"\\)": "\\(", "\\]": "\\["}[t]:
                open_.pop()
            elif open_:
                wrong += 1
            else:
                extra += 1
    return (missing, braces), sorted(env), (wrong, extra, len(open_))


def test_token_checks(spark):
    rng = random.Random(4)
    parts = ["{", "}", "\\begin{align}", "\\end{align}", "\\begin{figure}", "\\end{figure}", "\\begin{odd}", "\\end{odd}", "\\(", "\\)", "\\[", "\\]", "%", "\n", " a ", "\\alpha\\) "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(400)]
    df = spark.createDataFrame([("b", i, t) for i, t in enumerate(texts)], "book string, page_num int, tex string")
    braces = {r.page_num: (r.missing_open, r.unclosed) for r in tex.brace_balance(df).collect()}
    env = {}
    for r in tex.environment_pairing(df).collect():
        env.setdefault(r.page_num, []).append(r.problem)
    math = {r.page_num: (r.mismatched, r.extra, r.left_open) for r in tex.math_delimiter_balance(df).collect()}
    for i, t in enumerate(texts):
        assert (braces[i], sorted(env.get(i, [])), math[i]) == _stack_checks(t), t


def test_autofix(spark):
    rng = random.Random(5)
    pages = ["\n".join(rng.choice(["a &", "b &", "c", "", "\\x", "% y", "}", "long enough to stay apart &"]) for _ in range(rng.randint(1, 12))) for _ in range(200)]
    df = spark.createDataFrame([("b", i, t) for i, t in enumerate(pages)], "book string, page_num int, tex string")
    got = {r.page_num: r.tex for r in tex.autofix_tex(df).collect()}
    for i, text in enumerate(pages):
        lines = [x for x in re.sub(r"\n{3,}", "\n\n", text).split("\n") if x.strip() != "}"]
        out = []
        while lines:
            line, following = lines.pop(0), lines[0].strip() if lines else ""
            if line.strip().endswith("&") and len(line.strip()) < 20 and following and following[0] not in "\\%":
                line = line.rstrip() + " " + lines.pop(0).lstrip()
            out.append(line)
        assert got[i] == "\n".join(out)


def test_output_names(spark):
    rng = random.Random(6)
    existing = {"a.tex", "a_2.tex", "a_5.tex", "a_6.tex", "b_2.tex", "a_cn.tex"}
    files = [(i, rng.choice(["a.pdf", "b.pdf", "c.pdf"]), rng.random() < 0.3) for i in range(60)]
    df = spark.createDataFrame(files, "upload_id bigint, filename string, translate boolean")
    have = spark.createDataFrame([(n,) for n in existing], "name string")
    got = {r.upload_id: r.output_name for r in naming.unique_output_names(df, have, width=4).collect()}
    used = set(existing)
    for i, name, translated in files:
        base = name[0] + ("_cn" if translated else "")
        pick = next(c for c in [f"{base}.tex", *(f"{base}_{k}.tex" for k in range(2, 200))] if c not in used)
        used.add(pick)
        assert got[i] == pick
    clash = spark.createDataFrame([(0, "x.pdf", False), (1, "x.pdf", False), (2, "x_2.pdf", False), (3, "x.pdf", False)], "upload_id bigint, filename string, translate boolean")
    names = [r.output_name for r in naming.unique_output_names(clash).collect()]
    assert len(set(names)) == 4 and "x_2.tex" in names


def test_chunks_cover_pages_once(spark):
    pages = spark.createDataFrame([("b", p, "x" * (p * 37 % 500)) for p in range(60)], "book string, page_num int, text string")
    starts = spark.createDataFrame([("b", 3), ("b", 7), ("b", 40)], "book string, page_num int")
    got = chunks.chapter_chunks(pages, starts, 5, width=6).orderBy("page_num").collect()
    sizes = {}
    for r in got:
        sizes.setdefault(r.chunk, []).append(r.page_num)
    assert [len(sizes[c]) for c in range(3)] == [3, 4, 5] and sorted(sizes) == list(range(len(sizes))) and all(len(s) <= 5 for s in sizes.values())
    assert [r.page_num for r in got] == list(range(60)) and {3, 7, 40} <= {s[0] for s in sizes.values()}
    ten = spark.createDataFrame([("b", p, "t") for p in range(10)], "book string, page_num int, text string")
    assert sorted(chunks.fixed_chunks(ten, dense=True).collect()) == sorted(chunks.fixed_chunks(ten).collect())
    assert sorted(chunks.build_batch_prompts(ten, dense=True).collect()) == sorted(chunks.build_batch_prompts(ten).collect())
    three = chunks.chapter_chunks(ten, spark.createDataFrame([("b", 0), ("b", 3), ("b", 7)], "book string, page_num int"), 8)
    assert sorted(r["count"] for r in three.groupBy("chunk").count().collect()) == [3, 3, 4]
    seven = chunks.fixed_chunks(spark.createDataFrame([("b", p) for p in range(7)], "book string, page_num int")).groupBy("chunk").count()
    assert sorted(r["count"] for r in seven.collect()) == [3, 4]


def _filled(sizes, budget):
    """Chunk numbers of a sequential fill."""
    out, chunk, held = [], -1, None
    for size in sizes:
        if held is None or held + size > budget:
            chunk, held = chunk + 1, 0
        held += size
        out.append(chunk)
    return out


def test_greedy_filling(spark):
    """Blank, tiny, long and overlong pages; chunks over several blocks and stretches; gaps in the page numbers; a book without a name."""
    rng, books = random.Random(11), {}
    for b, (budget_share, pages) in enumerate([(0.3, 90), (0.02, 400), (1.5, 40), (0.1, 1), (0.0, 30), (0.5, 200)]):
        books[f"b{b}" if b else None] = [(p, int(rng.random() ** 3 * 700 * budget_share * 2) if rng.random() < 0.9 else rng.choice([0, 700, 701])) for p in sorted(rng.sample(range(2 * pages), pages))]
    books["same"] = [(p, 100) for p in range(300)]
    rows = [(b, p, n) for b, pages in books.items() for p, n in pages]
    df = spark.createDataFrame(rows, "book string, page_num int, chars int")
    for width, stretch in ((4096, 1024), (5, 3), (1, 1), (16, 2)):
        got = {(r.book, r.page_num): r.chunk for r in filling.greedy_chunks(df, "book", "page_num", "chars", 700, width, stretch).collect()}
        for book, pages in books.items():
            assert [got[book, p] for p, _ in pages] == _filled([n for _, n in pages], 700), (book, width)
    texts = spark.createDataFrame([("b", p, "x" * (p * 37 % 500)) for p in range(60)] + [("c", 0, None), ("c", None, "y")], "book string, page_num int, text string")
    got = {(r.book, r.page_num): (r.chars, r.chunk) for r in chunks.char_budget_chunks(texts, 700, width=6).collect()}
    assert [got["b", p] for p in range(60)] == list(zip([p * 37 % 500 for p in range(60)], _filled([p * 37 % 500 for p in range(60)], 700)))
    assert got["c", 0] == (0, 0) and len(got) == 61


def _slots(arrivals, limit, span):
    """Each request in its turn waits while ``limit`` starts lie in the window."""
    starts, out = [], []
    for at in arrivals:
        now = max(at, starts[-1]) if starts else at
        while len(window := [s for s in starts[-limit:] if now - s < span]) >= limit:
            now = window[0] + span
        starts.append(now)
        out.append(now)
    return out


def test_rate_windows(spark):
    """Sparse arrivals, bursts and lasting overload."""
    rng = random.Random(7)
    cases = {"sparse": [rng.randint(0, 4_000_000_000) for _ in range(200)], "overload": [rng.randint(0, 400_000_000) for _ in range(900)], "bursts": [rng.choice([0, 30, 60, 61, 300]) * 1_000_000 for _ in range(250)]}
    rows = [(i, m, t) for i, (m, t) in enumerate((m, t) for m, ts in cases.items() for t in ts)] + [(9999, "none", None)]
    df = spark.createDataFrame(rows, "request_id bigint, model string, t bigint").select("request_id", "model", F.timestamp_micros("t").alias("ts"))
    for limit, width in ((30, 4096), (4, 16)):
        found = usage.rate_limit_windows(df, limit=limit, width=width).collect()
        assert len(found) == len(rows) - 1
        for model, arrivals in cases.items():
            own = sorted((r for r in found if r.model == model), key=lambda r: (r.at_micros, r.request_id))
            want = _slots(sorted(arrivals), limit, 60_000_000)
            assert [r.start_micros for r in own] == want
            assert all(r.admitted == (r.start_micros == r.at_micros) and abs(r.wait_seconds - (r.start_micros - r.at_micros) / 1e6) < 1e-5 for r in own)


def test_prune_and_interrupt(spark):
    rows = [(f"t{i}", "completed" if i % 3 else "converting", f"2024-01-{1 + i % 28:02d} 00:00:00") for i in range(60)]
    df = spark.createDataFrame(rows, "task_id string, status string, at string").select("task_id", "status", F.col("at").cast("timestamp").alias("updated_at"))
    left = {r.task_id for r in tasks.task_prune(df, "2024-01-28 00:00:00", 7 * 86400, 25).collect()}
    alive = [r for r in rows if r[1] == "converting" or r[2] >= "2024-01-21"]
    ended = sorted((r[2], r[0]) for r in alive if r[1] == "completed")
    drop = {t for _, t in ended[: max(0, len(alive) - 25)]}
    assert left == {r[0] for r in alive} - drop
    stopped = {r.task_id: r.status for r in tasks.task_interrupted(df).collect()}
    assert stopped["t0"] == "failed" and stopped["t1"] == "completed"


def _remembered(ranges, keep):
    kept = []
    for p in ranges:
        if p and p != "all" and p not in kept:
            kept = [*kept, p][-keep:]
    return kept


def test_page_ranges_equal_a_plain_replay(spark):
    """Blocks of a few records: random ranges, cycles on and beyond the list, few ranges with rare new ones, gaps, nothing at all."""
    rng = random.Random(11)
    cases = {
        "random": [rng.choice(["all", "", None, *(f"{k}-{k + 1}" for k in range(8))]) for _ in range(150)],
        "on the list": [str(k % 5) for k in range(60)],
        "beyond it": [str(k % 6) for k in range(60)],
        "hits with rare news": [str(rng.randrange(5)) if rng.random() < 0.95 else str(rng.randrange(5, 9)) for _ in range(150)],
        "none": ["all", None, ""],
    }
    for name, ranges in cases.items():
        seqs = sorted(rng.sample(range(1 << 40), len(ranges)))
        rows = list(zip(seqs, ranges, strict=True))
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "seq bigint, pages string")
        for keep, width in ((5, 16), (2, 4096)):
            assert history.common_page_ranges(df, keep, width) == _remembered(ranges, keep), (name, keep)
    flags = history.preference_flags(spark.createDataFrame([(1, "1-2", True, None), (2, "3", None, "high")], "seq bigint, pages string, translated boolean, quality_mode string")).first()
    assert tuple(flags) == (True, "high", "1-2;3")


def _plain_lines(rows):
    """Glyph by glyph: heights of a page in order, each joining the line before while it is near its running mean."""

    def place(value):
        return (0, 0) if value is None else (2, 0) if value != value else (1, value)

    pages: dict = {}
    for b, p, g, ch, x0, top, size in rows:
        pages.setdefault((b, p), {}).setdefault("nan" if top != top else None if top is None else top + 0.0, []).append((x0, g, ch, size))
    out = []
    for (b, p), heights in pages.items():
        lines, mean = [], None
        for top in sorted(heights, key=lambda t: place(float("nan") if t == "nan" else t)):
            glyphs = sorted(heights[top], key=lambda t: (place(t[0]), place(t[1]), (t[2] is not None, t[2] or "")))
            known = isinstance(top, float)
            near = known and mean is not None and abs(top - mean) <= structure.LINE_TOLERANCE
            if not near:
                lines.append((top, []))
                mean = top if known else None
            for _ in glyphs if near else ():
                mean = top + (mean - top) / 2
            lines[-1][1].extend(glyphs)
        for n, (y0, glyphs) in enumerate(lines):
            sizes = [t[3] for t in glyphs if t[3] is not None and (t[3] > 0 or t[3] != t[3])]
            x0s = sorted((t[0] for t in glyphs if t[0] is not None), key=place)
            out.append((b, p, n, "".join(t[2] or "" for t in glyphs).strip(), str(round(sum(sizes) / len(sizes), 6) if sizes else 0.0), str(y0), str(x0s[0] if x0s else None)))
    return sorted(out, key=str)


@pytest.mark.parametrize("batch", [7, 64, 10_000])
@pytest.mark.parametrize("shuffled", [False, True])
def test_lines_of_glyphs_in_several_batches(spark, batch, shuffled):
    """Nulls, NaN, copies, far numbers and glyphs of any length, in batches of any size, against the plain rule."""
    rng = random.Random(5)
    nan = float("nan")
    rows = [(b, p, rng.choice([None, 0, 1, 2, 3, 1 << 40]) if rng.random() < 0.4 else i, rng.choice(["a", "b", "é", "😀", "ab", "", None]),
             rng.choice([None, 1.0, 2.0, nan, 3.0]), rng.choice([10.0, 11.0, 14.0, 40.0, 40.5, None, nan, 0.0, -0.0]), rng.choice([None, 0.0, 7.0, 10.0]))
            for b in ("x", "y", None) for p in (0, 1, None) for i in range(40)]
    rows = [*rows, *rows[:40], *[("z", 0, i, "abcdefghij"[i % 10], float(i % 50), float(i // 50 * 14), 10.0) for i in range(300)],
            *[("z", 1, i, "klmno"[i % 5], float(i % 20), float(i // 20 * 2), nan if i == 30 else 9.0) for i in range(200)]]
    if shuffled:
        rng.shuffle(rows)
    schema = "book string, page_num int, g_idx bigint, ch string, x0 double, top double, size double"
    glyphs = spark.createDataFrame(rows, schema).coalesce(2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        found = sorted(((r.book, r.page_num, r.line_no, r.text, str(r.size), str(r.y0), str(r.x0)) for r in structure.glyphs_to_lines(glyphs).collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == _plain_lines(rows)


def test_glyphs_do_not_move_one_by_one(spark):
    """One exchange, of rows that hold the text of a height; no aggregate collects glyphs."""
    glyphs = spark.createDataFrame([("b", 0, 0, "a", 0.0, 1.0, 9.0)], "book string, page_num int, g_idx int, ch string, x0 double, top double, size double")
    text = structure.glyphs_to_lines(glyphs)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1 and "collect_list" not in text and text.index("Exchange") < text.rindex("MapInArrow")
