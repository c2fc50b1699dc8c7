"""The ten corpus operators against brute force, round trips and held-out rows, and on odd tables."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from quire.llm import decontam, html, langid, lm, minhash, ogg, packing, queries, suffixes, tokens, toxicity  # noqa: E402

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i}" for i in range(30_000))
BASE = " ".join(f"word{i}" for i in range(40))
ODD = [
    (0, None, "en"), (1, "", "en"), (2, "   \n\t ", None), (3, "one two", "fr"), (4, "ONE two", "fr"), (5, BASE, "en"), (6, BASE, "en"), (7, BASE + " extra", None), (8, BASE.upper(), "en"), (9, LONG, "en"), (10, LONG + " tail", "en"),
    (11, "x" * 500, "de"), (12, "ab" * 300 + "é" * 80, "de"), (13, " nbsp  double space", "es"), (14, "12345 !!! 99", None), (14, "12345 !!! 99", None), (15, "a.b,c  d\n\ne", "es"), (16, "one <|endoftext|> two", "en"), (None, "no id here at all", "en"),
]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, print string, band string, block string, score string"


def odd(spark, rows=ODD):
    return spark.createDataFrame([(i, t, g, "s", len(t or ""), "x", "y", "z", "w") for i, t, g in rows], DOCS)


def words(t):
    return (t or "").encode().lower().split()


def crc(doc_id, n):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % n == 2


def shingles(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components(rows, percent=75):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    least = {i: i for i, _ in sets}
    links = [(i, j) for a, (i, x) in enumerate(sets) for j, y in sets[:a] if x and y and 100 * len(x & y) >= percent * len(x | y)]
    for _ in range(len(sets)):
        for i, j in links:
            least[i] = least[j] = min(least[i], least[j])
    return least


def test_minhash_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for f in range(25):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.choice([3, 5, 6, 8, 20, 60, 200]))]
        for _ in range(rng.choice([1, 2, 6])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, len(w) // 20])):
                w[rng.randrange(len(w))] = f"w{rng.randrange(300)}"
            rows.append((len(rows), " ".join(w)))
    want = components(rows)
    got = {r.doc_id: r for r in minhash.near_duplicates(odd(spark, [(i, t, None) for i, t in rows])).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(got[i].n_shingles == len(shingles(t)) and got[i].kept == (want[i] == i) for i, t in rows)


def test_minhash_chain_and_tiles(spark):
    """A long chain of near copies is one component, also when buckets are cut to small tiles."""
    w = [f"w{i}" for i in range(120)]
    rows = [(k, " ".join(w[2 * k : 2 * k + 60]), None) for k in range(25)]
    got = minhash.near_duplicates(odd(spark, rows), strays=2, members=3).collect()
    assert {r.doc_id: r.component_id for r in got} == components([(i, t) for i, t, _ in rows])


def test_minhash_bands_miss_next_to_nothing():
    assert (1 - 0.75**minhash.BAND) ** (minhash.REGISTERS // minhash.BAND) < 1e-5


def test_minhash_collisions_are_expected_ones():
    """Sets without a common member: registers are equal as often as the correction says; and estimates are not biased."""
    rng = np.random.default_rng(7)
    new = lambda n: np.sort(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
    same = np.mean([(minhash.sketch(new(40), 0) == minhash.sketch(new(40), 0)).mean() for _ in range(1500)])
    assert same == pytest.approx(minhash.collisions(40, 40, 0), rel=0.25)
    for n in (40, 2000):
        level, got = minhash.levels(n)[0], []
        for _ in range(60):
            common, a, b = new(6 * n // 8), new(n // 8), new(n // 8)
            x, y = (np.sort(np.concatenate([common, z])) for z in (a, b))
            got.append(minhash.estimate(minhash.sketch(x, level), minhash.sketch(y, level), len(x), len(y), level))
        assert np.mean(got) == pytest.approx(0.75, abs=0.015)


def test_minhash_parities_never_rule_out_a_link():
    rng = np.random.default_rng(9)
    for n in (1, 3, 30, 400, 9000):
        for apart in (0, 1, n // 8, n // 6):
            common, a, b = (rng.integers(0, 1 << 63, k, dtype=np.uint64) for k in (n, apart, apart))
            x, y = (np.unique(np.concatenate([common, z])) for z in (a, b))
            shared = len(np.intersect1d(x, y))
            bits = minhash._words([minhash.parities(x), minhash.parities(y)])
            linked = 100 * shared >= 75 * (len(x) + len(y) - shared)
            assert minhash.possible(bits[:1], bits[1], len(x), len(y), 75)[0] or not linked
    x, y = (rng.integers(0, 1 << 63, 100, dtype=np.uint64) for _ in range(2))
    bits = minhash._words([minhash.parities(x), minhash.parities(y)])
    assert not minhash.possible(bits[:1], bits[1], 100, 100, 75)[0]


def test_minhash_rows_that_share_an_id(spark):
    """Both texts of an id are linked, each with its own like; a null id is alone."""
    rows = [(14, BASE, None), (14, LONG, None), (20, BASE + " more", None), (21, LONG + " more", None), (3, "one two", None), (None, BASE, None), (20, BASE + " more", None)]
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(odd(spark, rows)).collect())
    n, m = len(shingles(BASE)), len(shingles(LONG))
    assert got == Counter({(14, n, 14, True): 1, (14, m, 14, True): 1, (20, n + 1, 14, False): 2, (21, m + 1, 14, False): 1, (3, 1, 3, True): 1, (None, n, None, True): 1})


def test_minhash_odd(spark):
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(odd(spark)).collect()]
    least = components([(i, t) for i, t, _ in ODD])
    assert len(got) == len(ODD)
    assert {(i, c) for i, _, c, _ in got} == {(i, least.get(i)) for i, _, _ in ODD}
    assert all(k for i, n, _, k in got if n == 0)
    assert minhash.near_duplicates(odd(spark, [])).count() == 0


def removed(rows):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            s = b[p : p + 100]
            if s in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(s)
        spans = sum(1 for p in range(len(b)) if gone[p] and not (p and gone[p - 1]))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [20_000, 2])
def test_suffixes_brute_force(spark, hot):
    rng = random.Random(2)
    letters = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared = [letters(rng.choice([99, 100, 101, 140, 400])) for _ in range(6)]
    rows = [(i, "".join(rng.choice([letters(rng.randrange(90)), rng.choice(shared)]) for _ in range(rng.randrange(6)))) for i in range(60)]
    rows += [(100, "z" * 350), (101, "z" * 150), (102, "ab" * 120), (103, shared[3] * 3), (104, None), (105, shared[4])]
    got = suffixes.remove_repeats(odd(spark, [(i, t, None) for i, t in rows]).repartition(3), hot=hot).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == removed(rows)


def test_suffixes_odd(spark):
    got = suffixes.remove_repeats(odd(spark)).collect()
    once = [(i, t) for k, (i, t, _) in enumerate(ODD) if i != 14 or k == 15]
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == removed(once) and len(got) == len(ODD)
    assert suffixes.remove_repeats(odd(spark, [])).count() == 0


def test_deep_shallow_sorts():
    rng = random.Random(3)
    strings = [bytes(rng.choice(b"ab\0") for _ in range(rng.randrange(70))) for _ in range(200)] + [b"a" * 60 + bytes([i % 5]) for i in range(40)]
    groups = np.array([rng.randrange(4) for _ in strings])
    order, common = suffixes.deep_shallow(strings, groups)
    want = sorted(range(len(strings)), key=lambda i: (groups[i], strings[i]))
    assert [(groups[i], strings[i]) for i in order] == [(groups[i], strings[i]) for i in want]
    for a, b, c in zip(order, order[1:], common[1:]):
        assert c == (-1 if groups[a] != groups[b] else suffixes.lcp(strings[a], strings[b]))


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_tokens_round_trip(spark, tmp_path):
    t = tokenizer()
    rows = sorted(((i, x) for i, x, _ in ODD), key=lambda r: -1 if r[0] is None else r[0])
    want, start = [], 0
    for i, x in rows:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    manifest = tokens.write_token_files(odd(spark), str(tmp_path), length=64, rows=4)
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in tokens.read_token_files(spark, manifest).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    shard = tokens.Shard(manifest[0][0])
    ids, mask = shard[0]
    assert len(ids) == 64 and mask.to_pylist() == [True] * 64 and ids.base is not None
    last = shard[len(shard) - 1][1].to_pylist()
    assert sum(last) == (manifest[0][2] - 1) % 64 + 1
    assert tokens.token_files(odd(spark, [])).count() == 0


def test_encoder_is_the_library():
    t, e = tokenizer(), tokens.Encoder(remember=50)
    texts = ["it's \"quoted.\" ok...", "a  b", " lead", "tab\tx y", "x\n\ny", "a b² c.", "<|endoftext|> hi", "Ünïcödé, wörds!", "12,5 kg.", "...", "\n", "a\nb\nc", "won't. don't?", "日本 語。x", "é. f"]
    assert e.encode(texts) == [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]


def check_packing(rows, texts):
    t = tokenizer()
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in seqs.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    for i, x in texts:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        own = sorted(pieces[i], key=lambda r: r.piece)
        own = own[:: len(own) // max(1, len({r.piece for r in own}))] if i == 14 else own  # the only repeated one: the same pieces twice
        assert sum(r.length for r in own) == len(ids) and [r.start for r in own] == list(np.cumsum([0] + [r.length for r in own])[:-1])
        assert all(r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in own)
        assert all(r.length == 1024 for r in own[1:])
    return len(seqs)


def test_packing(spark):
    rows = packing.pack_documents(odd(spark)).collect()
    check_packing(rows, [(i, x) for i, x, _ in ODD])
    assert packing.pack_documents(odd(spark, [])).count() == 0


def test_packing_plan_is_near_the_bound():
    rng = np.random.default_rng(5)
    lengths = np.clip(rng.lognormal(5.5, 0.8, 20_000).astype(int), 1, 1024)
    histogram = np.bincount(lengths, minlength=1025)[1:]
    groups, bound = packing.plan(histogram)
    held = sum(p * n for p, n in groups)
    assert (held == histogram).all()
    assert all((p * np.arange(1, 1025)).sum() <= 1024 for p, _ in groups)
    assert math.ceil(lengths.sum() / 1024) <= bound <= sum(n for _, n in groups) <= 1.002 * bound + 2
    hard = np.zeros(1024, dtype=int)
    hard[[399, 311, 511]] = 1000, 2000, 600  # 400 + 2 x 312 and 2 x 512 fill sequences
    groups, bound = packing.plan(hard)
    assert sum(n for _, n in groups) == bound == 1300


def test_packing_program_bounds_by_its_dual():
    """Lengths of which no two fit together need a sequence each: the tokens alone don't say so, the dual does."""
    histogram = np.zeros(1024, dtype=int)
    histogram[[599, 649, 699]] = 200, 100, 300
    groups, bound = packing.plan(histogram)
    assert sum(n for _, n in groups) == 600 and 580 <= bound <= 600 and -(-int(histogram @ np.arange(1, 1025)) // 1024) < 400
    shares, _ = packing.solve(histogram)
    assert all(len(members) == 1 for members in shares)


@pytest.mark.parametrize("counts,most", [({400: 1000, 310: 2000}, 1000), ({600: 500, 400: 500}, 500), ({500: 3, 7: 1}, 2), ({}, 0)])
def test_packing_plan_of_coarse_lengths(counts, most):
    histogram = np.zeros(1024, dtype=int)
    for length, n in counts.items():
        histogram[length - 1] = n
    groups, bound = packing.plan(histogram)
    assert bound <= most
    assert (sum((p * n for p, n in groups), np.zeros(1024, dtype=int)) == histogram).all()
    assert sum(n for _, n in groups) == most <= sum(n for _, n in packing.best_fit(histogram))


ITEM = "What is the total price when Anna buys 12 red apples and 7 green pears for 3 dollars each at the market near the old stone bridge"


def find(spark, texts, items):
    d = odd(spark, [(i, t, None) for i, t in texts])
    b = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in decontam.find_items(d, b).collect()}


def test_decontamination(spark):
    other = ITEM.replace("Anna", "Maria").replace("12", "40").replace("7", "9")
    filler = "some clean words that nobody would ever call a question of any kind at all " * 3
    texts = [(1, f"{filler} {ITEM} {filler}"), (2, f"{filler} {other}. {filler}"), (3, filler), (4, None), (5, ""), (6, ITEM.upper()), (7, ITEM[:40]), (8, "what is the total"), (9, "short item of five")]
    got = find(spark, texts, [(10, ITEM), (11, None), (12, ""), (13, "short item of five"), (14, "one two")])
    assert set(got) == {(1, 10), (2, 10), (6, 10), (9, 13)} and got[1, 10].verbatim and not got[2, 10].verbatim
    assert find(spark, texts, []) == {} and find(spark, [], [(10, ITEM)]) == {}


def test_decontamination_verbatim_short_items(spark):
    names = "Anna Bert Carla Dora Emil Fritz Gerda Hans met Ida Jan and Karl"
    items = [(1, "What is the capital of France?"), (2, "Which of the seven dwarfs in the old tale is never heard to speak?"), (3, names), (4, ITEM)]
    q, long = items[0][1], items[1][1]
    texts = [
        (1, f"Question: {q} Answer: Paris"), (2, q.replace("of ", "of\n")), (3, f"so, {q.lower()}"), (4, "Rome is the capital of Italy, and note: Rome is the capital of Italy."), (5, f"Question: {long}"), (6, long.replace("the ", "the\n  ")), (7, "they said " + names),
        (8, f"note: {ITEM}".replace(" at ", "\n> at\n").replace("buys ", "buys\n")), (9, "What is the capital of Spain?"), (10, "Question: " + long.replace("Which", "What").replace("dwarfs", "giants")),
    ]
    got = find(spark, texts, items)
    assert set(got) == {(1, 1), (2, 1), (3, 1), (5, 2), (6, 2), (7, 3), (8, 4), (9, 1)}
    assert all(r.verbatim == (k != (9, 1)) for k, r in got.items()) and got[1, 1].at == 1 and got[3, 1].at == 1


def test_decontamination_slots_must_agree(spark):
    item = "then Anna gave the ball to her brother and after lunch Anna took the ball back while nobody else in the room was looking at Anna closely"
    same, mixed = item.replace("Anna", "Eva"), item.replace("Anna", "Eva", 1).replace("Anna", "Ida", 1).replace("Anna", "Uma")
    got = find(spark, [(1, "so " + same), (2, "so " + mixed)], [(1, item.replace("gave the", "gave 5 the"))])
    assert (2, 1) not in got or got[2, 1].matched >= 4
    got = find(spark, [(1, "so " + same)], [(1, item)])
    assert (1, 1) in got and not got[1, 1].verbatim


def test_decontamination_finds_benchmark(spark):
    import re

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    fold = lambda s: " ".join(re.findall(r"[^\W_]+", (s or "").lower()))
    inside = {(d.doc_id, b.item_id) for d in docs.collect() for b in items.collect() if fold(b.text) in fold(d.text)}
    assert {(r.doc_id, r.item_id) for r in decontam.find_items(docs, items).collect()} >= inside


HTML = [
    ("<p>a<p>b", "a\n\nb"), ("<ul><li>x<li>y<ol start=3><li>z<li>w</ol></ul>", "- x\n- y\n  3. z\n  4. w"), ("a<script>b</script><style>c</style><!-- d -->e", "ae"), ("<div hidden>x</div><p style='display: none'>y</p>z", "z"),
    ("<table><tr><td>a<td>bb<tr><td>ccc<td>d</table>", "a   | bb\nccc | d"), ("<table><tr><td colspan=2>wide</td></tr><tr><td>a</td><td>b</td></tr></table>", "wide\na | b"), ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a | b\n  | c"),
    ("<pre>a\n  b</pre>c", "a\n  b\n\nc"), ("x &amp; y&lt;z", "x & y<z"), ("a<br>b<br><br>c", "a\nb\n\nc"), ("<b>a</b> <i>b</i>", "a b"), ("<title>t</title><h1>H</h1>body", "H\n\nbody"), ("", ""), (None, ""), ("<p", ""), ("</div></p>x", "x"), ("<blockquote>q</blockquote>", "> q"),
    ("<dl><dt>t<dd>d</dl>", "t\n    d"), ("<a href='x>y'>l</a>", "l"), ("<textarea>a<b></textarea>", "a<b>"), ("<input type=hidden value=x><input type=submit value=Go>", "Go"),
]


@pytest.mark.parametrize("source,want", HTML)
def test_html(source, want):
    assert html.extract(source)[0] == want


@pytest.mark.parametrize("source", ["<html><head><title>t</title><meta name=a><p>Hello", "<head><title>t</title>Hello", "<head><style>x</style> <link rel=x><br>Hello", "<head><script>x</script><div>Hello</div></head>", "<head>\n<title>t</title></br>Hello"])
def test_html_head_ends_by_implication(source):
    assert html.extract(source)[0].strip() == "Hello"


@pytest.mark.parametrize("source,want", [
    ("<table><tr>x<td>a</table>", "x\na"), ("<table><tbody>x<tr><td>a</td><b>y</b></tr></tbody><tfoot><p>z</table>", "xy\n\nz\na"), ("<table><tr><form><td>A<td>B</table>", "A | B"), ("<table><form><tr><td>A</td></form><td>B</table>", "A | B"), ("<table><tr><div>q<td>A<tr><b><td>B</table>", "q\nA\nB"),
    ("<table><tr><td><table><tr><form><td>a<td>b</table><td>c</table>", "a | b | c"), ("<math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>t</annotation></math>", "x=2"), ("<svg><title>t</title><desc>d</desc><defs><text>e</text></defs><text>one</text><text>two</text></svg>", "one two"),
    ("a <select><option>b<option label=c>d<optgroup label=e><option>f</select>", "a\nb\nc\ne\nf"), ("<datalist><option>x</datalist>y", "y"),
])
def test_html_text_outside_of_cells_and_in_drawings(source, want):
    assert html.extract(source)[0] == want


def test_html_depth_and_table(spark):
    assert html.extract("<div>" * 50_000 + "x")[0] == "x"
    assert "x" in html.extract("<table><tr><td>" * 200 + "x")[0]
    rows = spark.createDataFrame([(1, "u", "<p>a"), (1, "u", "<p>a"), (2, None, None)], "page_id long, url string, html string")
    assert sorted((r.page_id, r.text) for r in html.html_text(rows).collect()) == [(1, "a"), (1, "a"), (2, "")]
    assert html.html_text(rows.where("false")).count() == 0


@pytest.mark.parametrize("size", [64, 128, 4096, 4096 + 64, 255 * 64, 300_032])
def test_ogg_round_trip(size):
    data = bytes(random.Random(size).randrange(256) for _ in range(size))
    media = ogg.write_ogg(data)
    assert ogg.samples_of(ogg.read_ogg(media))[0] == data and ogg.write_ogg(data) == media


def test_ogg_big_packets_and_damage():
    packets = [b"h", b"a" * 200_000, b"b" * 255, b"", b"c"]
    raw = b"".join(ogg.pages(packets, [0, 1, 2, 3, 4], 7))
    media = ogg.read_ogg(raw)
    assert media.streams[7].packets == packets and media.streams[7].ended and not media.bad_pages
    bad = bytearray(raw)
    bad[70_000] ^= 1
    media = ogg.read_ogg(b"junk" + bytes(bad))
    assert media.bad_pages >= 1 and media.skipped_bytes >= 4 and packets[1] not in media.streams[7].packets and media.streams[7].packets[0] == b"h"
    # the checksum as the format defines it
    crc = 0
    for byte in raw[:22] + b"\0\0\0\0" + raw[26:29]:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 1 << 31 else crc << 1) & 0xFFFFFFFF
    assert crc == ogg.ogg_crc(raw[:22] + b"\0\0\0\0" + raw[26:29])


def test_ogg_table(spark):
    got = ogg.media_features(ogg.media_column(odd(spark))).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r for r in got}
    for i, t, _ in ODD:
        b = (t or "").encode()
        p = b + bytes(-len(b) % 64 if b else 64)
        assert (by[i].n_bytes, by[i].payload_bytes, by[i].payload_sha256, by[i].tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert by[5].media_sha256 == by[6].media_sha256


def test_ogg_null_and_damaged_media(spark):
    whole = ogg.write_ogg(bytes(range(256)) * 80)
    bad = bytearray(whole)
    bad[9000] ^= 1
    rows = [(1, 5, None), (2, 5, bytearray(whole)), (3, 5, bad), (4, 0, bytearray(b"no media")), (5, 0, bytearray())]
    got = {r.doc_id: r for r in ogg.media_features(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")).collect()}
    assert got[1].feature == "none" and got[2].payload_bytes == 256 * 80 and got[3].payload_bytes is None and got[3].feature.startswith("damaged;")
    assert got[4].payload_bytes == 0 and got[5].payload_bytes == 0


def test_ids_beyond_doubles_beside_a_null(spark):
    big = (1 << 53) + 1
    rows = odd(spark, [(big, "a b c", "en"), (None, "x", "en"), (big + 1, "z" * 300, "en")]).coalesce(1)
    assert {r.doc_id for r in suffixes.remove_repeats(rows).collect()} == {big, big + 1, None} == {r.doc_id for r in lm.lm_scores(rows).collect()}


def test_html_spans_lists_and_depth():
    assert html.extract("<table><tr><td colspan=2000>a<tr><td>b<td>c</table>")[0] == "a\nb | c"
    assert html.extract("<table><tr><td rowspan=70000>a<td>b<tr><td>c</table>")[0] == "a | b\n  | c"
    assert html.extract("<table><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d</table>")[0] == "a | b\n  | c\n  | d"
    assert html.extract("<table>" + "<tr><td colspan=1000 rowspan=65534>x" * 300 + "</table>")[0].count("x") == 300
    assert html.extract("<ol start=12345678901><li>a</ol>")[0] == "12345678901. a"
    assert "x" in html.extract("<div>" * 30_000 + "x" + "</div>" * 30_000)[0]


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.language_id(docs, per_language=60, epochs=2).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.95 and all(0 <= r.score <= 1 and crc(r.doc_id, 4) for r in got)


def test_language_odd(spark):
    got = langid.language_id(odd(spark), epochs=1).collect()
    assert len(got) == len(ODD)
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {0, 1, 2, 14}
    assert {r.lang_pred for r in langid.language_id(odd(spark, [(1, "abc", None)])).collect()} == {"und"}
    assert langid.language_id(odd(spark, [])).count() == 0


def test_forward_backward_is_exact():
    import itertools

    rng = np.random.default_rng(0)
    scores, transitions, lengths = rng.normal(size=(7, 3)), rng.normal(size=(3, 3)), np.array([4, 1, 2])
    post, pairs, z = langid.forward_backward(scores, lengths, transitions)
    want, want_pairs, want_z, at = np.zeros((7, 3)), np.zeros((3, 3)), 0.0, 0
    for n in lengths:
        paths = [(p, math.exp(sum(scores[at + i, c] for i, c in enumerate(p)) + sum(transitions[a, b] for a, b in zip(p, p[1:])))) for p in itertools.product(range(3), repeat=int(n))]
        total = sum(v for _, v in paths)
        want_z += math.log(total)
        for p, v in paths:
            for i, c in enumerate(p):
                want[at + i, c] += v / total
            for a, b in zip(p, p[1:]):
                want_pairs[a, b] += v / total
        at += n
    assert np.allclose(post, want) and np.allclose(pairs, want_pairs) and math.isclose(z, want_z)


def test_language_code_switching():
    rng = random.Random(0)
    en, fr = [f"the{i}ing" for i in range(60)], [f"le{i}eau" for i in range(60)]
    rows = [(" ".join(rng.choices(w, k=12)) + ".", g) for w, g in ((en, "en"), (fr, "fr")) for _ in range(60)]
    tagger = langid.Tagger(*langid.train(rows, epochs=6))
    text = " ".join(en[:6] + fr[:6])
    assert [tagger.languages[i] for i in tagger.tag([text])[0].argmax(axis=1)] == ["en"] * 6 + ["fr"] * 6


def test_language_feature_keys():
    """Keys made from sums over all characters are those of the features as strings."""
    lows = ["", "a", "ab", "abc", "abcd", "the", "stra\u00dfe", "\ud800x", "\U0001d4b3yz", "x" * 3000]
    keys, sizes = langid.feature_keys(lows)
    want = []
    for w in lows:
        n = len(w)
        ends = [c + x for c, part in (("p", lambda i: w[:i]), ("s", lambda i: w[n - i :])) for x in map(part, range(1, min(4, n) + 1))]
        want.append(["", "w" + w, *ends, *(w[i : i + 2] for i in range(n - 1)), *(w[i : i + 3] for i in range(n - 2))])
    assert sizes.tolist() == list(map(len, want)) and keys.tolist() == [int(langid.key(f)) for found in want for f in found]
    rows = langid.Rows(np.unique(keys), np.arange(2.0 * len(np.unique(keys))).reshape(-1, 2))
    assert (rows.keys[rows.find(keys)] == keys).all() and rows.find(np.array([langid.key("unseen"), 2**64 - 1], dtype=np.uint64)).tolist() == [-1, -1]
    assert np.allclose(rows.scores(lows), [rows.weights[rows.find(np.array([langid.key(f) for f in found]))].sum(axis=0) for found in want])


def test_language_holds_little():
    """What another operator left in a worker goes before the model comes; a tagger that meets many words keeps few."""
    import pyarrow as pa

    from quire.llm import common

    left = {i: str(i) for i in range(10)}
    common.take_over(left)
    model = langid.train([("the cat sat. on the mat.", "en"), ("le chat dort. sur la table.", "fr")], epochs=1)

    def load():
        assert not left and common._HELD[0] is None
        return model

    batch = pa.RecordBatch.from_pydict({"text": ["the cat", None, "la table"]})
    assert sum(b.num_rows for b in langid.tagged(iter([batch]), load, ["text", "lang", "score"])) == 3
    tagger = langid.Tagger(*model)
    for at in range(0, 300_000, 30_000):
        tagger.predict([" ".join(f"w{i}" for i in range(at, at + 30_000))])
        assert len(tagger.known) <= len(tagger.scores) <= 60_000


def test_workers_keep_no_words_between_tasks():
    """What an operator remembers of texts goes at a task's end: idle workers of an executor hold none of it."""
    import pyarrow as pa

    from quire.llm import common

    batch = pa.RecordBatch.from_pydict({"text": ["one two three", "four five"]})
    encoder = tokens.Encoder.shared(tokens.VOCABULARY)
    for part in common.text_slices(iter([batch]), cache=encoder):
        assert encoder.encode(part.column("text").to_pylist()) and encoder.known
    assert not encoder.known and not encoder.tails and tokens.Encoder.shared(tokens.VOCABULARY) is encoder
    hashes = common.WordHashes()
    for _ in common.text_slices(iter([batch]), cache=hashes):
        assert len(hashes.of([b"one", b"two"])) == 2 and hashes
    assert not hashes


def test_toxicity(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").collect()
    assert len(got) == labels.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    clean = [r.predicted for r in got if r.toxic == 0]
    toxic = [r.predicted for r in got if r.toxic == 1 and not r.held_out]
    assert sum(clean) / len(clean) < 0.05 and sum(toxic) / len(toxic) > 0.7


def test_toxicity_locates(spark):
    rng = random.Random(4)
    plain = lambda: " ".join(rng.choices([f"w{i}" for i in range(80)], k=8)).capitalize() + "."
    rows = [(" ".join([plain() for _ in range(5)] + (["You utter badword here."] if y else []) + [plain()]), y) for y in (0, 1) for _ in range(60)]
    weights, bias = toxicity.train(rows)
    scored = toxicity.sentence_scores(rows[-1][0], weights, bias)
    assert "badword" in max(scored, key=lambda x: x[1])[0] and sorted(p for _, p in scored)[-2] < 0.3


def test_toxicity_odd(spark):
    labels = spark.createDataFrame([(3, 1), (3, 0), (5, 0), (None, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(odd(spark), labels).collect()
    assert len(got) == len(ODD)
    assert all(r.score == pytest.approx(0, abs=1e-6) and r.predicted == 0 for r in toxicity.toxicity(odd(spark), labels.where("false")).collect())
    assert toxicity.toxicity(odd(spark, []), labels).count() == 0


def brute_lm(rows):
    """Backoff by recursion: a seen n-gram's own weight, else its context's backoff weight and the shorter context."""
    docs = [(i, ["<s>", *words(t), "</s>"]) for i, t in rows]
    n_grams, n_docs = Counter(), 0
    for i, w in docs:
        if not crc(i, 7):
            n_docs += 1
            n_grams.update(tuple(w[a:b]) for b in range(2, len(w) + 1) for a in range(max(0, b - lm.ORDER), b))
    n, v = sum(c for g, c in n_grams.items() if len(g) == 1), sum(len(g) == 1 for g in n_grams)

    def follow(h):  # how often training goes on from h
        return n_docs if h == ("<s>",) else n_grams[h]

    def p(h, x):
        if not h:
            return (n_grams[x,] + 1) / (n + v + 1)
        m = lm.PRIORS[len(h) - 1]
        return (n_grams[(*h, x)] + m * p(h[1:], x)) / (follow(h) + m)

    def arc(h, x):
        if h and not n_grams[(*h, x)]:
            back = math.log10(lm.PRIORS[len(h) - 1] / (follow(h) + lm.PRIORS[len(h) - 1])) if follow(h) else 0.0
            return back + arc(h[1:], x)
        return math.log10(p(h, x))

    out = []
    for i, w in docs:
        score = sum(arc(tuple(w[max(0, k - lm.ORDER + 1) : k]), w[k]) for k in range(1, len(w)))
        base = sum(math.log10((n_grams[x,] + 1) / (n + v + 1)) for x in w[1:])
        out.append((i, crc(i, 7), len(w) - 1, sum(n_grams[x,] > 0 for x in w[1:]), n, round(base, 5), round(score, 5)))
    return Counter(out)


@pytest.mark.parametrize("rows", [ODD, [], [(9, "a b", None)], [(i, f"the cat {i % 3} sat. On THE mat", None) for i in range(40)], [(i, " ".join(random.Random(i).choices("abcdefgh", k=random.Random(-i).choice([0, 3, 40, 1500]))), None) for i in range(30)]])
def test_lm_brute_force(spark, rows):
    got = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 5)) for r in lm.lm_scores(odd(spark, rows)).collect())
    want = brute_lm([(i, t) for i, t, _ in rows])
    assert sorted(map(str, got.elements())) == sorted(map(str, want.elements()))


def test_lm_automaton_sums_to_one():
    """All arcs and failures of a state share one mass."""
    texts = [" ".join(random.Random(i).choices("abcd", k=30)) for i in range(6)]
    block = lm.Block.of(texts)
    grams = block.grams()
    found = [np.bincount(e[e >= 0], minlength=len(k)) for k, e in grams]
    found[0][1] = 0
    total, types = int(found[0].sum()), int((found[0] > 0).sum())
    automaton = lm.Automaton(block, grams, found, total, types)
    # texts that read every token after every state of two words
    for h in ("a b", "c d", "d d"):
        mass = 0.0
        for x in ("a", "b", "c", "d", None):
            probe = lm.Block.of([f"{h} {x}" if x else h])
            ids = {w: i for i, w in enumerate(probe.hashes.tolist())}
            order = [ids[w] for w in block.hashes.tolist() if w in ids]
            assert len(order) == len(ids)
            own = probe.grams()
            by_key = [dict(zip(k.tolist(), c.tolist())) for (k, _), c in zip(grams, found)]
            mine = [np.array([by.get(k, 0) for k in keys.tolist()]) for by, (keys, _) in zip(by_key, own)]
            mass += 10 ** lm.Automaton(probe, own, mine, total, types).walk()[3]
        assert mass == pytest.approx(1, abs=0.01)  # but for words never seen
    assert automaton.walk().max() <= 0


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_queries_match_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.sql(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, SF).toPandas()
    c = sorted(want.columns)
    assert sorted(map(str, got[c].values.tolist())) == sorted(map(str, want[c].values.tolist()))


def test_pipeline(spark):
    """Each stage is judged on its own input, by brute force."""
    from quire.llm.common import materialize

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    first = materialize(stages["language ID"](spark, docs, SF), "t")
    assert first.columns == names and {r.doc_id for r in first.collect()} == {r.doc_id for r in docs.collect() if r.text and any(map(str.isalpha, r.text))}
    second = materialize(stages["MinHash near-dedup"](spark, first, SF), "t")
    want = components([(r.doc_id, r.text) for r in first.collect()])
    assert {r.doc_id for r in second.collect()} == {i for i, c in want.items() if i == c}
    third = materialize(stages["suffix-array dedup"](spark, second, SF), "t")
    gone = removed([(r.doc_id, r.text) for r in second.collect()])
    assert third.columns == names and all(len(r.text.encode()) <= gone[r.doc_id][0] - gone[r.doc_id][1] for r in third.collect())
    fourth = materialize(stages["benchmark decontamination"](spark, third, SF), "t")
    assert fourth.columns == names and fourth.count() <= third.count()
    last = stages["best-fit packing"](spark, fourth, SF).collect()
    check_packing(last, [(r.doc_id, r.text) for r in fourth.collect()])


def test_pipeline_keeps_rows_with_null_or_repeated_ids(spark):
    apart = "quite another text that says nothing of what the others say"
    texts = Counter([(5, BASE), (3, "one two"), (9, LONG), (None, "no id here at all"), (None, "no id here at all"), (None, apart), (7, apart), (2, "   \n\t "), (1, ""), (0, None), (11, "x" * 500), (12, ODD[12][1]), (13, ODD[13][1]), (14, "12345 !!! 99"), (14, "a second text under this id"), (15, ODD[16][1]), (16, ODD[17][1])])
    docs = odd(spark, [*ODD, (None, "no id here at all", "en"), (None, apart, "en"), (7, apart, "en"), (14, "a second text under this id", "en"), (1, "", "fr")])
    stages = dict(corpus_pipeline.STAGES)
    first = stages["MinHash near-dedup"](spark, docs, SF)
    assert first.columns == docs.columns and Counter((r.doc_id, r.text) for r in first.collect()) == texts
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 80").first().text
    more = odd(spark, [(1, "k" * 50 + BASE, "en"), (1, BASE + "l" * 50, "en"), (None, BASE, "en"), (2, item, "en"), (2, apart, "en"), (None, item, "en"), (None, apart, "en")])
    cut = stages["suffix-array dedup"](spark, more, SF).collect()
    assert sum(BASE in r.text for r in cut) == 1 and Counter(r.doc_id for r in cut) == Counter({None: 3, 1: 2, 2: 1})
    clean = stages["benchmark decontamination"](spark, more, SF).collect()
    assert Counter((r.doc_id, r.text) for r in clean) == Counter((r.doc_id, r.text) for r in more.collect() if r.text != item)


def test_anchor_keys_spread_over_buckets():
    """Anchors are the least hashes of their surroundings; their keys must not all fall to the first buckets."""
    text = np.random.default_rng(0).integers(0, 256, 1 << 20, dtype=np.uint8)
    _, keys, _ = suffixes.anchors(text)
    shares = np.bincount((keys >> np.uint64(58)).astype(np.int64), minlength=64)
    assert shares.max() < 2 * shares.mean() and shares.min() > shares.mean() / 2


def test_packing_is_one_python_step(spark, monkeypatch):
    """Encoding, crc32 and ranks share a worker; the second one a task had kept its memory for all later stages."""
    written, write = [], packing.materialize
    monkeypatch.setattr(packing, "materialize", lambda df, label: written.append((label, df._jdf.queryExecution().executedPlan().toString())) or write(df, label))
    for with_ids in (True, False):
        rows = packing.pack_documents(odd(spark), with_ids=with_ids).collect()
        assert ("ids" in rows[0]) == with_ids
        assert not with_ids or all(r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length for r in rows)
    assert [plan.count("MapInArrow") for label, plan in written if label == "pieces"] == [1, 1]
    alone = packing.pack(packing.encode_pieces(odd(spark))).collect()
    assert sorted((r.doc_id or -1, r.piece, r.length) for r in alone) == sorted((r.doc_id or -1, r.piece, r.length) for r in rows)


def test_encoder_scans_odd_texts_only(monkeypatch):
    """Texts of single separators are split once and not scanned for adjacent ones; the rest stays the library's."""
    t, e, looked = tokenizer(), tokens.Encoder(), []
    look = tokens.Encoder.separated
    monkeypatch.setattr(tokens.Encoder, "separated", lambda self, text: looked.append(text) or look(self, text))
    ids = lambda texts: [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    plain = ["a b\nc d.", "\x85", "é", "x\x00y z", "'s it's"]
    assert e.encode(plain) == ids(plain) and looked == ["\x85"]
    texts = [*plain, "a  b", "a \nb", "a\n b", "a\n\nb", " a", "a ", "\na", "a\n", "a \tb", "a\tb c", "a b", "q　 r", "\x1cz", "z\x1fy", "<|endoftext|>"]
    assert e.encode(texts) == ids(texts)
    assert all(e.encode([x]) == ids([x]) for x in texts)


def test_cut_texts_are_decoded_once(spark):
    """The filter on what is left reads the decoded text; decoding twice took two workers a task."""
    plan = corpus_pipeline.cut_repeats(spark, odd(spark).where("doc_id < 14"), SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan")[0].count("ArrowEvalPython") == 1
