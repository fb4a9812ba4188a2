"""Small tables with every odd case, and plain versions to compare with."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
FOLDER = "/root/testdata/sf0.001"


def words(text):
    return WORD.findall(text or "")


def odd_documents(seed=1, copies=3):
    """Null ids and texts, empty, blank and very long texts, repeated rows, copies and near copies, other scripts."""
    draw = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("ba", "ko", "ti", "re", "lu") for b in ("n", "s", "ra", "mi", "do", "ve")]
    base = " ".join(draw.choice(vocabulary) for _ in range(120)).split()
    near = [*base]
    near[60] = "changed"
    texts = [None, "", "   ", "\n\t", "One", "one two three", "ünïcode ΣΑΣ İx 日本語 😀 words", "a  b   c\td\x1ce", "<|endoftext|> in a text", "12345 !!! ???", " ".join(base), " ".join(near),
             "x " * 5000, " ".join(draw.choice(vocabulary) for _ in range(6000)), "Don't stop, it's 12 o'clock.\n\nNext paragraph."]
    texts += [" ".join(base)] * copies + [" ".join(draw.choice(vocabulary) for _ in range(draw.randint(1, 60))) for _ in range(25)]
    rows = [(3 * i, t, ("en", "de", None)[i % 3], f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[10], rows[4], (None, "no id here at all", "en", "s1", 17), (None, None, None, None, None)]
    draw.shuffle(rows)
    return rows


def multiset(rows):
    return sorted((tuple(r) for r in rows), key=repr)
