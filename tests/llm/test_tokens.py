"""Token store, packing and byte-pair coding against the public library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from llm_plain import FOLDER, multiset, odd_documents

from quire.llm import bpe, packing, token_store
from quire.llm.common import new_folder
from quire.llm.pieces import PieceEncoder, load

WORD_FILE, BYTE_FILE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))


def strings(seed=4):
    draw = random.Random(seed)
    made = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 70))) for letters in ("abcdeenrst 'ü.é,ß !?1\n", "aeinsthr ", " \n\tab\x1c\x85\xa0.", "日本語😀 xİΣς'") for _ in range(150)]
    return [t for _, t, *_ in odd_documents() if t] + made + ["a<|endoftext|>b <|startoftext|>", " <|endoftext|> "]


@pytest.mark.parametrize("path, byte_level", [(WORD_FILE, False), (BYTE_FILE, True)])
def test_pieces_equal_whole_texts(path, byte_level):
    library, pieces = load(path), PieceEncoder(load(path), byte_level, limit=200)  # a small limit forgets often
    for text in strings():
        assert np.frombuffer(pieces.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_backtracking_equals_library():
    library, vocabulary = load(WORD_FILE), bpe.Vocabulary(WORD_FILE)
    codec = bpe.TextCodec(vocabulary, limit=200)
    for text in strings(5):
        ids = library.encode(text, add_special_tokens=False).ids
        assert vocabulary.encode(text) == ids, text
        found, decoded = codec.run(text)
        assert [int(i) for i in found.split()] == ids
        assert decoded.decode() == vocabulary.decode(ids) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["<|ENDOFTEXT|>", "a<|EndOfText|>B <|endoftext|> X<|endoftext|>Y", "A<|STARTOFTEXT|>, <|endoftext|><|ENDOFTEXT|>"])
def test_special_strings_keep_their_case(text):
    """Strings that would be special only in lower case are ordinary text."""
    library, vocabulary = load(WORD_FILE), bpe.Vocabulary(WORD_FILE)
    ids = library.encode(text, add_special_tokens=False).ids
    found, decoded = bpe.TextCodec(vocabulary).run(text)
    assert [int(i) for i in found.split()] == ids
    assert decoded.decode() == library.decode(ids, skip_special_tokens=False)


def test_round_trip_rows(odd, empty):
    library = load(WORD_FILE)
    expected = []
    for doc, text, *_ in odd_documents():
        ids = library.encode(text or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        expected.append((doc, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert multiset(bpe.round_trip(odd, WORD_FILE).collect()) == multiset(expected)
    assert bpe.round_trip(empty, WORD_FILE).count() == 0
    some = {r.doc_id: r.ids for r in bpe.encoded(odd.where("doc_id IS NOT NULL"), WORD_FILE).collect()}
    assert some[12] == library.encode("One", add_special_tokens=False).ids


def test_key_index():
    keys = np.unique(np.random.default_rng(0).integers(-(1 << 62), 1 << 62, 5000))
    places = np.arange(len(keys)) * 7
    index = token_store.KeyIndex.from_bytes(token_store.KeyIndex.build(keys, places, places % 100).to_bytes())
    assert sorted(index.slots(keys).tolist()) == list(range(len(keys)))  # minimal and perfect
    found, offset, length = index.lookup(keys)
    assert found.all() and (offset == places).all() and (length == places % 100).all()
    strangers = np.setdiff1d(np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 5000), keys)
    assert index.lookup(strangers)[0].sum() == 0
    none = token_store.KeyIndex.build(keys[:0], places[:0], places[:0])
    assert not none.lookup(keys[:3])[0].any()


def test_store(spark, odd, empty):
    library = load(WORD_FILE)
    path = new_folder(spark, "store")
    token_store.write_store(odd, path, WORD_FILE, end_id=1, shard_tokens=500)
    store = token_store.read_store(spark, path)
    rows = sorted(((d, t) for d, t, *_ in odd_documents() if d is not None), key=lambda r: (r[0], r[1] is not None, r[1] or ""))
    expected, start = [], 0
    for doc, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        expected.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert multiset(token_store.digest(store).collect()) == multiset(expected)
    assert store.count() > 3  # several shards
    got = {r.doc_id: r.ids for r in token_store.fetch(store, [12, 18, 5, -1]).collect()}
    texts = dict(rows)
    assert got == {k: [*library.encode(texts[k], add_special_tokens=False).ids, 1] for k in (12, 18)}
    none = new_folder(spark, "store")
    token_store.write_store(empty, none, WORD_FILE)
    assert token_store.digest(token_store.read_store(spark, none)).count() == 0


def test_store_refuses_wide_ids(spark, odd):
    with pytest.raises(Exception, match="does not fit"):
        token_store.write_store(odd, new_folder(spark, "narrow"), WORD_FILE, width=1)


def check_packing(pieces, expected, capacity):
    """Every document whole, every sequence gapless and within capacity."""
    assert len(pieces) == sum(-(-len(i) // capacity) for i in expected)
    sequences = {}
    for r in pieces:
        assert r.start == 0 or r.length == capacity
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    crcs = sorted((len(i[a:b]), zlib.crc32(i[a:b].tobytes())) for i in expected for a, b in cuts(len(i), capacity))
    assert sorted((r.length, r.ids_crc32) for r in pieces) == crcs
    return len(sequences)


def cuts(n, capacity):
    first = n % capacity or capacity
    return [(0, first)] + [(a, a + capacity) for a in range(first, n, capacity)]


def test_packing(odd, empty):
    library = load(BYTE_FILE)
    ids = [np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for _, t, *_ in odd_documents()]
    for capacity in (64, 1024):
        used = check_packing(packing.pack(odd, BYTE_FILE, 2, capacity).collect(), ids, capacity)
        assert used <= -(-sum(map(len, ids)) // capacity) * 1.1 + 1
    assert packing.pack(empty, BYTE_FILE).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_plan(seed):
    """Every piece has one place, sequences are gapless, and few are used."""
    draw = np.random.default_rng(seed)
    capacity = int(draw.choice([7, 30, 100]))
    lengths = draw.integers(1, capacity + 1, int(draw.integers(0, 300)))
    if seed % 3 == 0:
        lengths = np.minimum(lengths, capacity // 3)  # small ones only
    counts = np.bincount(lengths, minlength=capacity + 1)
    places, bins = packing.plan(counts, capacity), {}
    for length, rank, count, first, offset in places:
        for k in range(count):
            bins.setdefault(first + k, []).append((offset, length))
    for length in range(1, capacity + 1):
        ranks = sorted((r, c) for n, r, c, *_ in places if n == length)
        assert [r for r, _ in ranks] == [sum(c for _, c in ranks[:i]) for i in range(len(ranks))] and sum(c for _, c in ranks) == counts[length]
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity and sum(n > capacity // 3 for _, n in own) <= 2 or max(n for _, n in own) <= capacity // 3 + 1
    # First fit in descending order as a yardstick.
    rooms = []
    for n in sorted(lengths.tolist(), reverse=True):
        k = next((k for k, r in enumerate(rooms) if r >= n), None)
        if k is None:
            rooms.append(capacity)
            k = -1
        rooms[k] -= n
    assert len(bins) <= len(rooms) * 1.05 + 1


def test_registered_queries(spark):
    from quire.llm.queries import QUERIES

    n = spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    for name in ("op4_token_store", "op7_bpe"):
        assert QUERIES[name](spark, FOLDER).count() == n


@pytest.mark.parametrize("path, byte_level", [(WORD_FILE, False), (BYTE_FILE, True)])
def test_columns_of_pieces_equal_whole_texts(path, byte_level):
    """Slices, forgetting and texts that go whole change no id; each different word meets the library once."""
    library, texts = load(path), [None, "", *strings(6), "a\nb c.\nDe", "x***", "ͅab", "ab\ncd***\nE,", None]
    for limit, remembered in ((1 << 24, 1 << 20), (300, 150), (1, 1)):
        codec, found = PieceEncoder(load(path), byte_level, remembered=remembered), []
        for first, ids, lengths in codec.batches(pa.array(texts), 7, limit):
            assert first == len(found) and len(ids) == lengths.sum()
            found += [part.tolist() for part in np.split(ids, np.cumsum(lengths)[:-1])]
        assert found == [[*library.encode(t or "", add_special_tokens=False).ids, 7] for t in texts]
    codec, calls = PieceEncoder(load(path), byte_level), []
    whole = codec.whole
    codec.whole = lambda text: calls.append(text) or whole(text)
    for _ in codec.batches(pa.array([f"ab{k * 'x'}***\nCd{k * 'y'}, ef" for k in range(50)])):
        pass
    assert len(calls) <= 3, calls  # the marks and the line feed, not the words around them
