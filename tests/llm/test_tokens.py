"""BPE, stretches, Simple-8b, token files and token counts against the libraries and brute force."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from maskwright.llm import bpe, simple8b, token_counts, token_files
from maskwright.llm.pretokens import PATTERN, UNSETTLED, pieces, plain
from maskwright.llm.stretches import Table

RANKS = P.path("byte_bpe_50k.tiktoken")
PARTS = ["a", "b", "aa", "the", "é", "\n", " ", "  ", " a", "'s", " don't", "ing", "!", "9", "\x1c", "\xa0", "日本", "😀", "ab" * 9, "<|endoftext|>", "࢏", "\t", ".\nFoo", ", ", "\r\n", "½", "x" * 40]


def mixed_texts(n, seed, most=14):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, most))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.codec(RANKS).ranks, special_tokens={})


def test_codec_equals_the_library(library):
    assert PATTERN == P.PATTERN
    own = bpe.codec(RANKS)
    texts = mixed_texts(2000, 1, 30)
    for text, runs in zip(texts, own.all_runs(texts), strict=True):
        ids = np.concatenate([*runs, np.empty(0, np.uint32)]).tolist()
        assert ids == library.encode_ordinary(text), text
        assert own.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["a" * 20_000, "ab" * 9000, "日" * 5000, "word " * 90_000, ("x" * 9 + "\n\n") * 40_000, " " * 3000])
def test_very_long_pretokens_and_texts(library, text):
    assert bpe.codec(RANKS).encode(text).tolist() == library.encode_ordinary(text)


def test_queue_follows_ranks_not_merge_order():
    """A merge may make a pair of lower rank, which comes before the rest of its bucket."""
    codec = bpe.Codec.__new__(bpe.Codec)
    ranks = {bytes([i]): i for i in range(256)} | {b"aba": 256, b"ab": 257, b"bab": 258}
    codec.ranks, codec.size, codec.bytes_of = ranks, 259, [b""] * 259
    for token, rank in ranks.items():
        codec.bytes_of[rank] = token
    codec.single = np.arange(256)
    codec.pair = np.array([[ranks.get(bytes((a, b)), bpe.NO_RANK) for b in range(256)] for a in range(256)])

    def plain_merge(raw):
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while True:
            best = min(((ranks.get(a + b, bpe.NO_RANK), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))), default=(bpe.NO_RANK, 0))
            if best[0] == bpe.NO_RANK:
                return [ranks[p] for p in parts]
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    rnd = random.Random(5)
    words = [bytes(rnd.choice(b"abc") for _ in range(rnd.randint(1, 12))) for _ in range(300)]
    assert [x.tolist() for x in codec.merge(words)] == [plain_merge(w) for w in words]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.codec(RANKS).ranks, special_tokens={})
    assert bpe.codec(RANKS).encode(text).tolist() == enc.encode_ordinary(text)


def test_plain_texts_split_at_spaces():
    assert plain("one two.\nThree") and not plain("one  two") and not plain("a\tb") and not plain("a \nb") and not plain("࢏")
    assert UNSETTLED.search("日") and "".join(p for some in pieces("a  b\n c") for p in some) == "a  b\n c"


def test_table_against_a_dictionary():
    calls = []

    def encode(some):
        calls.extend(some)
        return [np.frombuffer(x.encode(), np.uint8).astype("<u4").tobytes() for x in some]

    own, rnd = Table(encode, most=1 << 17), random.Random(2)
    words = [f"w{i}" for i in range(150_000)]
    for _ in range(40):
        texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 400))).encode() for _ in range(20)]
        for text, ids in zip(texts, own.ids(texts), strict=True):
            assert bytes(ids.astype(np.uint8)) == text
    assert own.size <= own.slots * 5 // 8 <= 5 << 14 and own.ids([b"", b"a", b""])[1].tolist() == [97]
    assert own.ids([]) == [] and len(calls) >= len(set(calls))


def test_query_digests(spark, library):
    texts = [*mixed_texts(60, 4), None, "", "x " * 300_000]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    rows = {r.doc_id: r for r in bpe.digests(df, RANKS).collect()}
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        wanted = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()
        assert (rows[i].n_tokens, rows[i].ids_sha256, rows[i].decoded_sha256) == (len(ids), *wanted)
    back = bpe.decode_rows(bpe.encode_rows(df, RANKS, checked="ok"), RANKS).collect()
    assert all(r.ok and bytes(r.decoded).decode() == (r.text or "") and r.n_tokens == "z" for r in back)
    assert bpe.digests(df.limit(0), RANKS).collect() == []


def random_ids(rng):
    n = int(rng.choice([0, 1, 2, 5, 1023, 1024, 1025, 3000]))
    kind = rng.choice(["tok", "small", "zero", "wide", "mix"])
    ids = {"tok": lambda: rng.integers(0, 50257, n), "small": lambda: rng.integers(0, 3, n), "zero": lambda: np.zeros(n, int), "wide": lambda: rng.integers(0, 2**60, n), "mix": lambda: 2 ** rng.integers(0, 40, n)}[kind]()
    return ids.astype(np.uint64)


def test_simple8b_round_trip_by_lists_and_blocks():
    rng = np.random.default_rng(0)
    for _ in range(60):
        lists = [random_ids(rng) for _ in range(rng.integers(0, 6))]
        words, begins, blocks = simple8b.encode(lists)
        sizes = np.array([len(x) for x in lists], dtype=np.int64)
        for a, b in zip(lists, simple8b.decode_lists(words, begins, sizes), strict=True):
            assert (a == b).all()
        edges, at = np.append(begins, len(words)), 0
        for ids, n in zip(lists, blocks, strict=True):
            if n:
                own = words[edges[at] : edges[at + n]]
                last = simple8b.decode_block(own, begins[at : at + n] - edges[at], len(ids), n - 1)
                assert (last == ids[(n - 1) * simple8b.BLOCK :]).all()
            at += n
    with pytest.raises(ValueError, match="60 bits"):
        simple8b.encode([np.array([1 << 60], dtype=np.uint64)])


def test_simple8b_packs():
    words, _, _ = simple8b.encode([np.zeros(1024, np.uint64)])
    assert len(words) == 9
    words, _, _ = simple8b.encode([np.full(1024, 50_000, np.uint64)])
    assert len(words) == 342


def test_token_file(spark):
    from tokenizers import Tokenizer

    texts = [*mixed_texts(80, 9), None, "", "long words " * 40_000]
    rows = [(i * 7 % 89, t) for i, t in enumerate(texts)] + [(3, "again"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    to = f"{spark.conf.get('spark.checkpoint.dir')}/tokens-test"
    token_files.write_tokens(df, P.path("byte_bpe_50k.json"), to, end_id=2)
    tokens = spark.read.schema(token_files.FILE_SCHEMA).parquet(to)
    found = token_files.with_starts(token_files.checksums(tokens), tokens).orderBy("start").collect()
    own = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = {}
    for i, t in rows:
        ids.setdefault(i, []).append([*own.encode(t or "", add_special_tokens=False).ids, 2])
    start = 0
    for r in found:
        wanted = {zlib.crc32(np.array(x, "<u4").tobytes()): len(x) for x in ids[r.doc_id]}
        assert r.start == start and wanted[r.ids_crc32] == r.n_tokens
        start += r.n_tokens
    order = [r.doc_id for r in found]
    assert order == [None, *sorted(i for i, _ in rows if i is not None)]
    whole = token_files.read_tokens(tokens).filter("doc_id = 3").collect()
    assert sorted(r.ids for r in whole) == sorted(ids[3])


def test_other_tokenizer_files_go_through_the_library():
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    own, texts = Tokenizer.from_file(path), mixed_texts(40, 3)
    assert [x.tolist() for x in token_files.encoder(path).encode(texts)] == [own.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json"])
def test_token_counts_and_their_cache(spark, name):
    texts = [*mixed_texts(40, 6), None, "", "", "same", "same", "same", "w " * 5000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(41, "same", 1), (None, "odd", 1)], "doc_id long, text string, content int")
    cache = f"{spark.conf.get('spark.checkpoint.dir')}/counts-{name}"
    path = P.path(name)
    rows = token_counts.count_tokens(df, path, cache).collect()
    count = token_counts.counter(path)
    text_of = {i: t or "" for i, t in enumerate(texts)} | {None: "odd"}
    for r in rows:
        own = {text_of[r.doc_id], "same" if r.doc_id == 41 else text_of[r.doc_id]}
        assert (r.n_bytes, r.n_tokens) in {(len(t.encode()), count([t])[0]) for t in own}
        assert r.over_limit == (r.n_tokens > 4096)
    assert len(rows) == len(texts) + 2
    stored = spark.read.parquet(cache)
    assert stored.count() == len({t or "" for t in texts} | {"odd"}) == stored.select("content").distinct().count()
    # a second call, with one new text, counts that one only
    more = df.unionByName(spark.createDataFrame([(99, "quite new", 1)], df.schema))
    assert token_counts.count_tokens(more, path, cache).count() == len(rows) + 1
    assert spark.read.parquet(cache).count() == stored.count() + 1
    assert token_counts.count_tokens(df.limit(0), path, cache).collect() == []
    # rows that two writers left twice count once
    spark.read.parquet(cache).write.parquet(f"{cache}-twice")
    spark.read.parquet(cache).write.mode("append").parquet(f"{cache}-twice")
    assert sorted(map(str, token_counts.count_tokens(df, path, f"{cache}-twice").collect())) == sorted(map(str, rows))


def test_token_counts_with_one_text_in_half_of_all_rows(spark):
    df = spark.createDataFrame([(i, "the very same text" if i % 2 else f"text {i}") for i in range(4000)], "doc_id long, text string")
    path = P.path("piece_bpe_32k.model")
    rows = token_counts.count_tokens(df, path, f"{spark.conf.get('spark.checkpoint.dir')}/counts-hot").collect()
    count = token_counts.counter(path)
    assert sorted(r.doc_id for r in rows) == list(range(4000))
    assert {r.n_tokens for r in rows if r.doc_id % 2} == {count(["the very same text"])[0]}
    assert all(r.n_tokens == count([f"text {r.doc_id}"])[0] for r in rows if r.doc_id % 400 == 0)


def thue_morse(n):
    """A word on which polynomial hashes modulo powers of two meet those of its complement."""
    return "".join("ab"[i.bit_count() & 1] for i in range(n))


@pytest.mark.parametrize("n", [64, 256, 1024, 4096])
def test_words_whose_hashes_meet(library, n):
    from tokenizers import Tokenizer

    word = thue_morse(n)
    other = word.translate(str.maketrans("ab", "ba"))
    texts = [f"x {word}", f"x {other}", f"x {word} {other} y"]
    own, path = bpe.codec(RANKS), P.path("byte_bpe_50k.json")
    for text in texts:
        assert own.encode(text).tolist() == library.encode_ordinary(text)
    plain_ids = Tokenizer.from_file(path)
    assert [x.tolist() for x in token_files.encoder(path).encode(texts)] == [plain_ids.encode(t, add_special_tokens=False).ids for t in texts]


def test_table_where_all_hashes_meet():
    own = Table(lambda some: [np.frombuffer(x.encode(), np.uint8).astype("<u4").tobytes() for x in some])
    own.hashes = lambda raw, begins, ends: raw[begins].astype(np.uint64)
    rnd = random.Random(3)
    for _ in range(100):
        texts = [" ".join("".join(rnd.choice("abc") for _ in range(rnd.choice([1, 2, 3, 300]))) for _ in range(rnd.randint(0, 30))).encode() for _ in range(4)]
        for text, ids in zip(texts, own.ids(texts), strict=True):
            assert bytes(ids.astype(np.uint8)) == text


def test_token_file_edges(spark):
    """An empty table, clashing columns, and one doc_id with most rows, which fills several ranges."""
    path = P.path("byte_bpe_50k.json")
    rows = [(i, f"text {i}", "x") for i in range(40)] + [(17, f"hot {i % 9}", "x") for i in range(400)] + [(None, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, part string").withColumn("words", F.lit(1)).withColumn("tie", F.lit("z"))
    folder = spark.conf.get("spark.checkpoint.dir")
    for name, some in (("hot", df.repartition(3)), ("none", df.limit(0))):
        token_files.write_tokens(some, path, f"{folder}/tokens-{name}", end_id=2)
        tokens = spark.read.schema(token_files.FILE_SCHEMA).parquet(f"{folder}/tokens-{name}")
        found = token_files.with_starts(token_files.checksums(tokens), tokens).orderBy("start").collect()
        assert len(found) == (len(rows) if name == "hot" else 0)
        ids = [-1 if r.doc_id is None else r.doc_id for r in found]
        assert ids == sorted(ids) and [r.start for r in found] == [sum(r.n_tokens for r in found[:i]) for i in range(len(found))]
        if name == "hot":
            assert len({r.part for r in found if r.doc_id == 17}) > 1
            own = token_files.encoder(path)
            wanted = sorted((-1 if i is None else i, zlib.crc32(np.append(own.encode([t or ""])[0], 2).astype("<u4").tobytes())) for i, t, _ in rows)
            assert sorted(zip(ids, (r.ids_crc32 for r in found), strict=True)) == wanted


def test_new_stretches_go_to_the_model_alone_and_once():
    """Without the library's splitting and alignment, by byte letters; what was seen is not encoded again."""
    from tokenizers import Tokenizer

    file = P.path("byte_bpe_50k.json")
    own, plainly = token_files.Encoder(open(file, "rb").read()), Tokenizer.from_file(file)
    rnd = random.Random(21)
    letters = "aeinorst,.!'é\u00ad\x00\x7f½ß0"
    words = ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 14))) for _ in range(8000)]
    texts = [rnd.choice(["", " ", "\n"]) + "".join(w + rnd.choice(" \n") for w in words[i : i + 40]) for i in range(0, 8000, 40)] + mixed_texts(300, 22, 40)
    calls = []
    own.memory.table.encode = lambda some: calls.extend(some) or own.encode_stretches(some)
    for _ in range(2):
        for text, ids in zip(texts, own.encode(texts), strict=True):
            assert ids.tolist() == plainly.encode(text, add_special_tokens=False).ids, text
    assert len(calls) == len(set(calls)) > 7000 and own.bare.pre_tokenizer is None
    assert own.memory.table.most == 1 << 21
    assert [len(x) for x in own.encode_pieces(["", "a"])] == [0, 4] and own.encode_pieces([]) == []


def test_marks_behind_a_word_do_not_make_it_new():
    """A mark or digit after a letter begins a pre-token, so a word is encoded once, whatever follows it."""
    from tokenizers import Tokenizer

    file = P.path("byte_bpe_50k.json")
    own, plainly = token_files.Encoder(open(file, "rb").read()), Tokenizer.from_file(file)
    calls = []
    own.memory.table.encode = lambda some: calls.extend(some) or own.encode_stretches(some)
    words = ["stone", "don", "café", "À", "ÿ", "×", "÷", "¿", "ª", "ā", "A", "z", "_", "7"]
    marks = [*map(chr, range(33, 128)), "'s", "'tis", "'ll", "...", ".x", "9×.", "’s", "", "@x.org"]
    texts = ["a", "."] + [" " + w + m + e for w in words for m in marks for e in ("", " on")]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == plainly.encode(text, add_special_tokens=False).ids, text
    assert {x for x in calls if x.startswith(" stone") and not x[1:].isalpha()} == {" stone\x7f", " stone’s"}
    assert len(calls) == len(set(calls))
