"""Near-duplicates, mixing, media and page texts against brute force."""

import hashlib
import random
import time
import zlib
from pathlib import Path

import numpy as np
import pytest
import xxhash

from maskwright.llm import html_text, media, mixing, simhash


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    """Smallest doc_id reachable over links of at most 3 bits."""
    n, label = len(fps), list(range(len(fps)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(n):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 3:
                label[max(root(i), root(j))] = min(root(i), root(j))
    members = {}
    for i in range(n):
        members.setdefault(root(i), []).append(fps[i][0])
    return [min((m for m in members[root(i)] if m is not None), default=None) for i in range(n)]


TEXTS = ["", None, " \t\n", "One", "one two", "ONE two", "one two three four", "Ünï Code wörds hëre", "a\x1cb c\x0bd e\x0cf", "x " * 70_000, "é\xa0f g h i"]


def test_fingerprints():
    for t in TEXTS:
        assert simhash.fingerprint(t or "") == plain_fingerprint(t), t


def test_components_of_documents(spark):
    rnd = random.Random(1)
    base = [" ".join(rnd.choice(["red", "blue", "green", "fish", "bird", "tree", "stone", "sky"]) + str(rnd.randint(0, 9)) for _ in range(120)) for _ in range(6)]
    texts = list(TEXTS)
    for b in base:
        texts.append(b)
        for _ in range(12):
            words = b.split()
            words[rnd.randrange(120)] = "changed"
            texts.append(" ".join(words))
        texts += [b.upper(), b]
    rows = [(i + 5, t) for i, t in enumerate(texts)] + [(None, base[0]), (None, "alone " * 9), (9, base[1])]
    fps = [(i, plain_fingerprint(t)) for i, t in rows]
    wanted = sorted(zip([i for i, _ in fps], [f"{f:016x}" for _, f in fps], plain_components(fps), strict=True), key=str)
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, component_id int")
    found = [tuple(r) for r in simhash.near_duplicates(df).collect()]
    assert sorted(found, key=str) == wanted
    assert simhash.near_duplicates(df.limit(0)).collect() == []
    left = {p.name.rsplit("-", 1)[0] for p in Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")).iterdir()}
    assert "simhash-labels" in left and "simhash" not in left


@pytest.mark.parametrize("long", [2, 512])
def test_links_miss_nothing(spark, monkeypatch, long):
    monkeypatch.setattr(simhash, "LONG", long)
    rnd = random.Random(2)
    fps = {rnd.getrandbits(64) for _ in range(60)}
    for f in list(fps):
        for _ in range(8):
            g = f
            for _ in range(rnd.randint(1, 5)):
                g ^= 1 << rnd.randrange(64)
            fps.add(g)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    wanted = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    links = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()
    assert len(links) == len(wanted) and {(r.a, r.b) for r in links} == wanted


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 400)] + [(1000, 1001)], "a long, b long")
    labels = {r.node: r.label for r in simhash.components(edges).collect()}
    assert set(labels.values()) == {0, 1000} and len(labels) == 403
    assert simhash.components(edges.limit(0)).collect() == []


def test_one_of_each_group_stays(spark, tmp_path):
    rows = [(3, "same text here now", "a"), (1, "same text here now", "b"), (1, "same text here now", "c"), (None, "same text here now", "d"), (7, "quite another set of words", "e"), (None, "third thing altogether yes", "f"), (None, "third thing altogether yes", "g")]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string, fp string").write.parquet(path)
    kept = simhash.without_near_duplicates(spark.read.parquet(path))
    assert kept.columns == ["doc_id", "text", "fp"]
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 7), (True, 0)]


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Share by weight, stop at the bound, share the excess again, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, full = {}, set()
    while True:
        left = share * sum(sizes.values()) - sum(most * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        total = sum(w[s] for s in open_)
        target = {s: most * sizes[s] if s in full else left * w[s] / total for s in names}
        over = {s for s in open_ if target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


@pytest.mark.parametrize("seed", range(3))
def test_mixing_targets(spark, seed):
    rnd = random.Random(seed)
    names = [None, "", "Z", "a", "é", "😀", "￿", *(f"s{i}" for i in range(rnd.randint(0, 6)))]
    rows = [(i, " ".join("w" * rnd.randint(0, 30)), rnd.choice(names), "x") for i in range(900)]
    rows += [(None, None, "nulls", "x"), (5, "", "nulls", "x"), (7, "two words", "Z", "x"), (7, "two words", "Z", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    found = mixing.counted(df).collect()
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    wanted = plain_targets(sizes)
    assert len(found) == len(rows)
    taken = dict.fromkeys(sizes, 0)
    for r in found:
        assert r.source_size == sizes[r.source] and r.size == len((r.text or "").split())
        assert r.target == pytest.approx(wanted[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert sum(taken.values()) == pytest.approx(1.5 * sum(sizes.values()), rel=0.1)
    twins = [r.copies for r in found if r.doc_id == 7 and r.text == "two words"]
    assert len(set(twins)) == 1
    assert sorted(map(str, mixing.counted(df.repartition(7)).collect())) == sorted(map(str, found))
    mixed = mixing.mixed(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r.copies for r in found)


def test_mixing_edges(spark, monkeypatch):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.counted(empty).collect() == []
    nothing = spark.createDataFrame([(1, None, "a"), (2, "", None)], empty.schema)
    assert [(r.size, r.target, r.taken) for r in mixing.counted(nothing).collect()] == [(0, 0.0, 0)] * 2
    some = spark.createDataFrame([(i, "a b c", "abc"[i % 3]) for i in range(60)], empty.schema)
    broadcast = sorted(map(str, mixing.counted(some).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(str, mixing.counted(some).collect())) == broadcast


def test_media_round_trip(spark):
    texts = ["", None, "hello", "é" * 40, "x" * 64, "word " * 20_000, "hello"]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, media int")
    rows = {r.doc_id: r for r in media.features(df).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(raw), len(padded), zlib.crc32(padded[-64:]))
        assert r.payload_sha256 == hashlib.sha256(padded).hexdigest()
        assert r.media_bytes == len(padded) + 44 and r.media_sha256 == hashlib.sha256(media.to_wav(padded)).hexdigest()
    assert rows[2].feature == rows[6].feature and rows[0].feature == rows[1].feature
    assert media.features(df.limit(0)).collect() == []
    for r in media.tensor_table(media.media_column(df)).collect():
        found = media.from_tensors(bytes(r.tensors))
        mel, _, spans = media.analysed(media.to_wav((texts[r.doc_id] or "").encode() + bytes(r.payload_bytes - r.n_bytes)))
        cubes, cuts = media.tensors(mel, spans)
        assert found.schema.field("mel").type.shape == list(media.SHAPE) and found.num_rows == len(cubes)
        assert not len(cubes) or np.array_equal(found.column("mel").to_numpy_ndarray(), cubes)
        assert all(a < b for a, b in zip(found.column("start_s").to_pylist(), found.column("end_s").to_pylist(), strict=True))
        assert found.column("segment").to_pylist() == cuts[:, 0].tolist()
        assert rows[r.doc_id].feature == media.described(r.frames, r.level, found)


def naive_analysis(samples, rate):
    """Resampling by the sinc sum itself, mel bands by a plain transform, segments by a state machine."""
    x = [(b - 128) / 128 for b in samples]
    up, down, taps = 320, 441, media.TAPS
    assert (rate * up, media.RATE * down) == (media.RATE * down, rate * up)
    filt = np.array([np.sinc((i - taps * up // 2) / max(up, down)) * (0.5 - 0.5 * np.cos(2 * np.pi * i / (taps * up))) for i in range(taps * up)])
    filt *= up / filt.sum()
    length = -(-len(x) * media.RATE // rate)
    count = max(1, -(-(length - media.FRAME) // media.HOP) + 1)
    y = []
    for n in range((count - 1) * media.HOP + media.FRAME):
        # the input, spread by ``up`` with zeros between, under the filter's middle
        at = n * down
        total = 0.0
        for k in range(at // up - taps, at // up + taps + 1):
            i = at - k * up + taps * up // 2
            if 0 <= k < len(x) and 0 <= i < taps * up:
                total += x[k] * filt[i]
        y.append(total)
    edges = [700 * (10 ** (m / 2595) - 1) for m in np.linspace(0, 2595 * np.log10(1 + media.RATE / 2 / 700), media.BANDS + 2)]
    mel, energy = [], []
    for f in range(count):
        cut = np.array(y[f * media.HOP : f * media.HOP + media.FRAME])
        cut = (cut - cut.mean()) * np.array([0.5 - 0.5 * np.cos(2 * np.pi * i / media.FRAME) for i in range(media.FRAME)])
        bins = [abs(sum(cut * np.exp(-2j * np.pi * k * np.arange(media.FRAME) / media.POINTS))) ** 2 for k in range(media.POINTS // 2 + 1)]
        bands = []
        for low, mid, high in zip(edges, edges[1:], edges[2:], strict=False):
            at = [k * media.RATE / media.POINTS for k in range(len(bins))]
            bands.append(sum(p * max(0, min((h - low) / (mid - low), (high - h) / (high - mid))) for h, p in zip(at, bins, strict=True)))
        mel.append([np.log(b + 1e-6) for b in bands])
        energy.append(10 * np.log10((cut * cut).mean() + 1e-9))
    middle, on, spans = np.median(energy), False, []
    for f, e in enumerate(energy):
        if not on and e - middle >= media.RISE:
            spans.append([f, count])
            on = True
        elif on and e - middle < media.FALL:
            spans[-1][1] = f
            on = False
    return np.array(mel), np.array(energy), spans


@pytest.mark.parametrize("n", [64, 640, 2560])
def test_features_equal_a_naive_analysis(n):
    rng = np.random.default_rng(n)
    samples = (128 + 100 * np.sin(np.arange(n) / 3) * (np.arange(n) // 400 % 2) + rng.integers(-9, 9, n)).astype(np.uint8).tobytes()
    mel, energy, spans = media.analysed(media.to_wav(samples))
    plain_mel, plain_energy, plain_spans = naive_analysis(samples, media.STORED_RATE)
    assert np.allclose(mel, plain_mel, atol=0.02) and np.allclose(energy, plain_energy, atol=0.02)
    assert spans.tolist() == plain_spans


def test_resampling_and_segments():
    for rate in (44_100, 16_000, 11_025):
        x = np.sin(np.arange(rate) * 2 * np.pi * 440 / rate).astype(np.float32)
        y = media.resampled(x, rate, 8000, 0, 8000)
        assert abs(y[100:-100] - np.sin(np.arange(8000) * 2 * np.pi * 440 / 8000)[100:-100]).max() < 0.02
        parts = [media.resampled(x, rate, 8000, a, b) for a, b in ((0, 3001), (3001, 8000))]
        assert np.array_equal(np.concatenate(parts), y)
    level = np.array([0, 0, 2, 0.5, 0, -0.5, -2, 0, 0.9, 3, 3, 0, 0, 0, 0.0])
    assert media.segments(level).tolist() == [[2, 6], [9, 15]]
    noise = np.random.default_rng(0).integers(0, 256, 40_000, dtype=np.uint8).tobytes()
    mel, energy, spans = media.analysed(media.to_wav(noise))
    assert mel.shape == (len(energy), media.BANDS) and (spans[1:, 0] >= spans[:-1, 1]).all()
    with pytest.raises(ValueError, match="WAV"):
        media.from_wav(b"nothing")


PAGES = [
    ("", ""),
    (None, ""),
    ("plain &amp; <b>bold</b> text", "plain & bold text"),
    ("<p>one<p>two", "one\n\ntwo"),
    ("<ul><li>a<li>b<ul><li>c</ul></ul>", "- a\n- b\n  - c"),
    ("<ol start=4><li>a<li value=9>b<li>c</ol>", "4. a\n9. b\n10. c"),
    ("<table><tr><td>a<td>bbb<tr><td>cc<td>d</table>", "a   bbb\ncc  d"),
    ("<table><tr><td rowspan=2>x<td>1<tr><td>2</table>", "x  1\n   2"),
    ("<title>no</title><script>if(a<b){'</p>'}</script><style>x{}</style>yes", "yes"),
    ("<div style='DISPLAY : none'>no</div><p hidden>no</p><template>no</template>ok", "ok"),
    ("a<br>b<hr>c", "a\nb\nc"),
    ("<pre> keep\n  this </pre>", " keep\n  this"),
    ("<div>a</div><div>b</div>", "a\nb"),
    ("x < y & z > w", "x < y & z > w"),
    ("<!-- no --><!DOCTYPE html>t<a href='>'>link</a>", "tlink"),
    ("<details><summary>s</summary>hidden</details><details open><summary>t</summary>shown</details>", "s\nt\nshown"),
    ("unclosed <b>tag <i", "unclosed tag"),
    ("<td>stray cell", "stray cell"),
    ("a&nbsp;b&#x41;&bogus;", "a bA&bogus;"),
    ("<select><option>1<option>2</select>", "1\n2"),
    ("<dl><dt>k<dd>v</dl>", "k\n  v"),
    ("<p>un <span> two </span> tre</p>", "un two tre"),
]


DRAWN = [
    ("a <svg viewBox='0 0 9 9'><title>no</title><desc>no</desc><defs><text>no</text></defs><metadata>no</metadata><text x=1>Sales</text><text>2024</text></svg> b", "a Sales 2024 b"),
    ("<p>if <math><mi>x</mi><mo>=</mo><mn>1</mn><mtext>&nbsp;kg</mtext></math> then", "if x=1 kg then"),
    ("<math><semantics><mi>y</mi><annotation encoding='application/x-tex'>no</annotation></semantics></math>", "y"),
    ("<math><mfrac><mn>1</mn><mn>2</mn></mfrac></math>", "1 2"),
    ("<body><svg class=icon />all <p>the rest</p>of it", "all\n\nthe rest\n\nof it"),
    ("<div><math/>kept</div>", "kept"),
    ("<svg/>first", "first"),
    ("<svg><title/><style/><path d='M0'/><g/><text>t<tspan>u</tspan></text></svg>v", "tu v"),
    ("<svg><style>x{}</style><script>1</script><text><![CDATA[a<b &amp; c]]></text></svg>", "a<b &amp; c"),
    ("<svg><foreignObject><div>in<br>side</div></foreignObject></svg>out", "in\nside\nout"),
    ("<svg><path><p>left open</p>", "left open"),
    ("<svg display=none><text>no</text></svg><svg style='display:none'><text>no</text></svg><svg><a href=u/><g visibility=hidden><text>no</text></g></a></svg>ok", "ok"),
    ("<div/>not closed by the slash", "not closed by the slash"),
    ("<head><title>no</title></head><svg><symbol><text>no</text></symbol></svg>yes", "yes"),
]


@pytest.mark.parametrize("html", ["<svg>" * 50_000 + "x", "<svg><g>" * 20_000, "<svg><foreignobject>" * 20_000, "<math><mi/>" * 20_000, "<svg><![CDATA[" * 20_000])
def test_bad_drawings_take_no_recursion_and_little_time(html):
    html_text.extract(html)


SHOWN = [
    ("<div style='visibility:hidden'>no <b style='visibility: visible'>yes</b> no</div>", "yes"),
    ("<div style='visibility:visible;display:none'>no</div><p style='display:none;display:block'>yes", "yes"),
    ("Name: <input value='Ann Lee'> <input type=hidden value=no><input type=password value=no><input type=submit value=Send>", "Name: Ann Lee Send"),
    ("<input type=search placeholder='Look up'><input type=checkbox value=on>", "Look up"),
    ("<ol start=-1><li>a<li>b<li value=12345678>c<li value=99999999999999>d</ol>", "-1. a\n0. b\n12345678. c\n12345679. d"),
    ("<table><tr><td rowspan=0>x<td>1<tr><td>2<tr><td>3</table>", "x  1\n   2\n   3"),
    ("<table><tr><td colspan=900>wide cell<td>r<tr><td>a<td>b</table>", "wide cell  r\na" + " " * 10 + "b"),
    ("<table><tr><td>" + "word " * 20 + "<td>end<tr><td>a<td>b</table>", ("word " * 12)[:-1] + "   end\n" + ("word " * 8)[:-1] + "\na" + " " * 60 + "b"),
    ("<table><tr><td>a<td>" + "long last cell " * 9 + "</table>", "a  " + ("long last cell " * 9)[:-1]),
]


@pytest.mark.parametrize(("html", "text"), SHOWN[:6] + SHOWN[8:])
def test_what_is_shown(html, text):
    assert html_text.extract(html) == text


def grid(rows):
    """The first column of each cell, by a set of taken places."""
    taken, out = set(), []
    for r, row in enumerate(rows):
        at, firsts = 0, []
        for across, down in row:
            while (r, at) in taken:
                at += 1
            firsts.append(at)
            taken |= {(r + i, at + k) for i in range(down) for k in range(across)}
            at += across
        out.append(firsts)
    return out


@pytest.mark.parametrize("seed", range(30))
def test_cells_of_a_column_begin_under_each_other(seed):
    rnd = random.Random(seed)
    rows = [[(rnd.choice([1, 1, 1, 2, 5]), rnd.choice([1, 1, 2, 4])) for _ in range(rnd.randint(1, 5))] for _ in range(rnd.randint(1, 8))]
    words = iter(f"w{i}" + "x" * rnd.randint(0, 9) for i in range(10**6))
    said = [[next(words) for _ in row] for row in rows]
    html = "<table>" + "".join("<tr>" + "".join(f"<td colspan={a} rowspan={d}>{w}" for (a, d), w in zip(row, own, strict=True)) for row, own in zip(rows, said, strict=True)) + "</table>"
    lines = html_text.extract(html).split("\n")
    assert [x.split() for x in lines] == said
    at = {}
    for line, firsts, own in zip(lines, grid(rows), said, strict=True):
        for column, word in zip(firsts, own, strict=True):
            assert at.setdefault(column, line.index(word)) == line.index(word)
    assert [at[c] for c in sorted(at)] == sorted(at.values())


def seen(node, shown=True):
    """The words of a plain tree (tag, style, children) that are visible, by recursion."""
    if isinstance(node, str):
        return [node] if shown else []
    _, style, children = node
    if style == "display:none":
        return []
    shown = {"visibility:hidden": False, "visibility:visible": True}.get(style, shown)
    return [w for c in children for w in seen(c, shown)]


@pytest.mark.parametrize("seed", range(30))
def test_all_visible_words_of_random_trees(seed):
    rnd, count = random.Random(seed), iter(range(10**6))

    def some(depth):
        if not depth or rnd.random() < 0.3:
            return f"w{next(count)}"
        return rnd.choice("div span p b section".split() if depth > 3 else ["span", "b", "i"]), rnd.choice(["", "", "", "display:none", "visibility:hidden", "visibility:visible"]), [some(depth - 1) for _ in range(rnd.randint(0, 4))]

    def written(node):
        return f" {node} " if isinstance(node, str) else f"<{node[0]} style='{node[1]}'>{''.join(map(written, node[2]))}</{node[0]}>"

    tree = ("div", "", [some(6) for _ in range(5)])
    # a paragraph can't hold blocks: its start tag would end it
    html = written(tree).replace("<p ", "<article ").replace("</p>", "</article>")
    assert html_text.extract(html).split() == seen(tree)


def test_cells_that_span_very_much_take_little_time():
    cell = "<td rowspan=65534 colspan=1000>x"
    began = time.process_time()
    assert html_text.extract("<table><tr>" + cell * 1000).split() == ["x"] * 1000
    html_text.extract("<table>" + ("<tr>" + cell * 20) * 100)
    html_text.extract("<table>" + "<tr><td rowspan=9>a<td>b" * 3000)
    assert time.process_time() - began < 5


def test_pages_of_an_empty_table_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "<p>a", "u"), (1, "<p>a", "u"), (None, None, None)], "page_id long, html string, url string")
    assert html_text.extracted(df.limit(0)).collect() == []
    assert sorted(map(str, html_text.extracted(df).collect())) == sorted(["Row(page_id=1, url='u', text='a')"] * 2 + ["Row(page_id=None, url=None, text='')"])


@pytest.mark.parametrize(("html", "text"), DRAWN)
def test_drawings_and_formulas(html, text):
    assert html_text.extract(html) == text


@pytest.mark.parametrize(("html", "text"), PAGES)
def test_pages(html, text):
    assert html_text.extract(html or "") == text


def test_pages_in_a_table(spark):
    df = spark.createDataFrame([(i, h, "u") for i, (h, _) in enumerate(PAGES)], "page_id long, html string, text string")
    rows = html_text.extracted(df).collect()
    assert {r.page_id: r.text for r in rows} == {i: t for i, (_, t) in enumerate(PAGES)}


@pytest.mark.parametrize("html", ["<div>" * 50_000 + "x", "<ul><li>" * 20_000, "<table><tr><td>" * 2000 + "deep", "<" * 100_000, "<a b='" * 50_000, "</p>" * 20_000, "<p>" * 50_000 + "x", "<!--" * 50_000, "<script>" * 5000])
def test_bad_pages_take_no_recursion_and_little_time(html):
    html_text.extract(html)


def word_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_edited_copies_go_and_others_stay(spark, tmp_path):
    """The stage's groups are those of an exact Jaccard of 0.8 over five-word shingles."""
    rnd = random.Random(4)
    texts = []
    for family in range(12):
        base = [f"w{rnd.randrange(4000)}" for _ in range(rnd.choice([6, 40, 181, 400]))]
        texts.append(base)
        for _ in range(25 if family else 60):  # most of the first family are like its base, not like each other
            some = list(base)
            for _ in range(rnd.randint(1, 6)):
                some[rnd.randrange(len(some))] = f"new{rnd.randrange(10**6)}"
            texts.append(some)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(9000, "  "), (9001, None), (9002, "a b"), (9003, "A\tB"), (9004, "a b c")]
    rnd.shuffle(rows)
    sets = {i: word_set(t) for i, t in rows}
    label = {i: i for i in sets}
    linked = 0
    for i in sorted(sets):
        for j in sorted(sets):
            both = len(sets[i] | sets[j])
            if j < i and (not both or len(sets[i] & sets[j]) * 5 >= both * 4):
                linked += sets[i] != sets[j]
                if label[i] != label[j]:
                    low, high = sorted((label[i], label[j]))
                    label = {k: low if v == high else v for k, v in label.items()}
    path = str(tmp_path / "edited")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    kept = {r.doc_id for r in simhash.without_near_duplicates(spark.read.parquet(path)).collect()}
    assert linked > 200 and kept == set(label.values())


def test_near_copies_come_from_the_index_of_positional_bytes(spark):
    """Pairs at a Jaccard of just 0.8 share an entry and the counted bytes; strangers don't reach the count."""
    rng = np.random.default_rng(8)
    prints, wanted = [], set()
    for n, (x, y, both) in enumerate([(5, 4, 4), (6, 5, 5), (10, 8, 8), (9, 9, 8), (15, 12, 12), (45, 45, 40), (500, 400, 400)] * 6):
        hashes = rng.integers(0, 1 << 64, x + y - both, dtype=np.uint64)
        for i, own in enumerate((hashes[:x], hashes[x - both :])):
            prints.append((2 * n + i, len(own), simhash.long_print(np.sort(own)).view(np.int64).tolist(), False))
        wanted.add((2 * n, 2 * n + 1))
    df = spark.createDataFrame(prints, "set_id long, size int, print array<long>, open boolean")
    none = spark.createDataFrame([], "key long, n long")
    found = simhash.index_pairs(df, none, simhash.Scratch(spark, "index-test")).collect()
    assert len(found) == len(wanted) and {(r.a, r.b) for r in found} == wanted
    assert len(simhash.long_print(np.empty(0, np.uint64))) == 0


@pytest.mark.parametrize("crowded", [2, 8, 10**6])
def test_crowded_entries_lose_no_near_copy(spark, tmp_path, monkeypatch, crowded):
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    rnd = random.Random(crowded)
    rows = []
    for _ in range(5):
        base = [f"w{rnd.randrange(4000)}" for _ in range(rnd.choice([9, 60, 120]))]
        for _ in range(24):
            some = list(base)
            for _ in range(rnd.randint(0, 4)):
                some[rnd.randrange(len(some))] = f"new{rnd.randrange(10**6)}"
            rows.append((len(rows), " ".join(some)))
    sets = {i: word_set(t) for i, t in rows}
    label = {i: i for i in sets}
    for i, j in ((i, j) for i in sets for j in range(i)):
        if len(sets[i] & sets[j]) * 5 >= len(sets[i] | sets[j]) * 4 and label[i] != label[j]:
            low, high = sorted((label[i], label[j]))
            label = {k: low if v == high else v for k, v in label.items()}
    path = str(tmp_path / "crowded")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    kept = {r.doc_id for r in simhash.without_near_duplicates(spark.read.parquet(path)).collect()}
    assert 5 < len(kept) < len(rows) and kept == set(label.values())


def test_large_groups_of_near_copies_cost_few_pairs(spark, tmp_path, monkeypatch):
    """Sets of crowded entries meet a few others each, and shingles are dealt out only where many of a group stay apart."""
    monkeypatch.setattr(simhash, "CROWDED", 16)
    compared, apart = [], []
    alike, rare = simhash.alike, simhash.rare_pairs
    monkeypatch.setattr(simhash, "alike", lambda pairs, sets: compared.append(pairs.count()) or alike(pairs, sets))
    monkeypatch.setattr(simhash, "rare_pairs", lambda own, sets, scratch: apart.append(own.count()) or rare(own, sets, scratch))
    rnd = random.Random(11)
    base = [f"w{i}" for i in range(200)]
    texts = [base]
    for i in range(150):
        some = list(base)
        for _ in range(1 + i % 3 if i % 15 else 9):
            some[rnd.randrange(200)] = f"new{rnd.randrange(10**6)}"
        texts.append(some)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    path = str(tmp_path / "group")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    kept = {r.doc_id for r in simhash.without_near_duplicates(spark.read.parquet(path)).collect()}
    sets = {i: word_set(t) for i, t in rows}
    near = {i: {j for j in sets if len(sets[i] & sets[j]) * 5 >= len(sets[i] | sets[j]) * 4} for i in sets}
    group, more = {0}, {0}
    while more := {j for i in more for j in near[i]} - group:
        group |= more
    assert kept == {0} | {i for i in sets if i not in group}
    assert compared[0] <= simhash.HEADS * len(rows) and not apart


def test_rare_entries_are_the_first_of_one_order(spark):
    rng = np.random.default_rng(3)
    common = rng.integers(0, 1 << 64, 30, dtype=np.uint64)
    sets = [np.unique(np.concatenate((common, rng.integers(0, 1 << 64, n, dtype=np.uint64)))) for n in (0, 1, 4, 90, 400)] * 2
    df = spark.createDataFrame([(i, i, s.view(np.int64).tolist()) for i, s in enumerate(sets)], "set_id long, label long, shingles array<long>")
    found = {}
    for r in simhash.rare_entries(df).collect():
        assert r.size == len(sets[r.set_id]) and r.label == r.set_id
        found.setdefault(r.set_id, {})[r.place] = r.shingle
    often = np.bincount((np.concatenate(sets) >> np.uint64(46)).astype(int), minlength=simhash.BUCKETS)
    for i, s in enumerate(sets):
        ordered = sorted(s.tolist(), key=lambda h: (often[h >> 46], h))[: len(s) // 5 + 1]
        assert found[i] == dict(enumerate(np.array(ordered, dtype=np.uint64).view(np.int64).tolist()))
