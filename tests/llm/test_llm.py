"""The operators against brute force, the libraries themselves and round trips, with odd rows and hot groups."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.llm import ann, bitslice, bloomlm, common, langid, ngramjoin, packing, pieces, pii, tokencounts, tokenfiles, wordhash
from docloom.llm.components import components
from docloom.llm.queries import PIECE_BPE, WORD_BPE

SCHEMA = "extra string, doc_id long, text string, lang string, source string, n_chars long, class string, part int"
EMPTY = "extra string, doc_id long, text string, lang string, source string, n_chars long"


def sentence(r, n, words=400):
    return " ".join(f"{'abcdefghij'[w % 10]}{'klmnopqrst'[w // 10 % 10]}{w}{r.choice(['', '', '.', ','])}" for w in (r.randrange(words) for _ in range(n)))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    base = sentence(r, 120)
    out = [(i, sentence(r, r.randrange(1, 200)), r.choice(["en", "fr"])) for i in range(60)]
    out += [(100 + i, base, "en") for i in range(30)]  # exact copies
    near = base.split()
    for i in range(40):
        w = list(near)
        for _ in range(r.randrange(0, 5)):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        out.append((200 + i, " ".join(w), "en"))
    out += [(300, None, "en"), (301, "", None), (302, "   \n\t ", "fr"), (303, "one two", "en"), (304, "one two", "en"), (None, "null id here too", "en"), (None, "", "en")]
    out += [(305, sentence(r, 30_000), "en"), (306, "A b\x0bC  d é É 漢字 <|endoftext|>'s", "fr"), (306, "repeated id", "fr"), (307, "123 456", None)]
    out += [(303, "one two", "en"), (306, "repeated id", "fr"), (None, "", "en")]  # rows repeated whole
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([("x", i, t, g, "s", len(t or ""), "c", 1) for i, t, g in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], EMPTY)


@pytest.fixture(scope="module")
def word_bpe():
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(WORD_BPE)
    return lambda t: np.array([*model.encode(t or "", add_special_tokens=False).ids, 1], "<u4")


def first(x):
    return (x is not None, x or 0)


# 1 ------------------------------------------------------------------------------------------------------


def test_token_files_hold_every_document(spark, docs, rows, word_bpe):
    got = [tuple(r) for r in tokenfiles.token_files_query(docs, WORD_BPE).collect()]
    want, start = [], 0
    for i, t, _ in sorted(rows, key=lambda x: (first(x[0]), x[1] is not None, x[1] or "")):
        ids = word_bpe(t)
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want


def test_token_files_open_again(spark, docs, tmp_path, word_bpe, rows):
    path = f"file://{tmp_path}/files"
    tokenfiles.write_token_files(docs, WORD_BPE, 1, path)
    back = tokenfiles.read_token_files(tokenfiles.open_token_files(spark, path), with_ids=True).collect()
    assert Counter(bytes(r["ids"]) for r in back) == Counter(word_bpe(t).tobytes() for _, t, _ in rows)


def test_token_files_of_nothing(empty):
    assert tokenfiles.token_files_query(empty, WORD_BPE).count() == 0


@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1))))
@settings(max_examples=200, deadline=None)
def test_rank_code_round_trip(ranks):
    a = np.array(ranks, np.uint32)
    assert tokenfiles.unpack_ranks(*tokenfiles.pack_ranks(a), len(a)).tolist() == ranks


def test_file_is_checked():
    raw = tokenfiles.file_bytes(np.array([1]), np.array([2]), np.array([3, 70_000]))
    assert [x.tolist() for x in tokenfiles.parse_file(raw)] == [[1], [2], [3, 70_000]]
    for bad in (raw[:-1], b"x" * 40):
        with pytest.raises(ValueError):
            tokenfiles.parse_file(bad)


# 2 ------------------------------------------------------------------------------------------------------


def grams(text, k):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute_components(rows, k, num):
    sets = [grams(t, k) for _, t, _ in rows]
    at = list(range(len(rows)))

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                at[find(a)] = find(b)
    least = defaultdict(list)
    for i, (doc, _, _) in enumerate(rows):
        least[find(i)].append(doc)
    return Counter((doc, len(sets[i]), min((d for d in least[find(i)] if d is not None), default=None)) for i, (doc, _, _) in enumerate(rows))


@pytest.mark.parametrize(("k", "num"), [(4, 85), (5, 80)])
def test_join_components(docs, rows, k, num):
    assert Counter(map(tuple, ngramjoin.ngram_join(docs, k, num, 100).collect())) == brute_components(rows, k, num)


@pytest.mark.parametrize("bound", [("GROUP", 8), ("GRAMS", 150)])
def test_join_of_a_large_group(spark, monkeypatch, bound):
    """Many near copies, few of which are alike enough: groups are split over blocks and finished in pairs of them."""
    monkeypatch.setattr(ngramjoin, *bound)
    r = random.Random(3)
    base, rows = sentence(r, 60, 10**6).split(), []
    for i in range(70):
        w = list(base)
        for _ in range(r.randrange(0, 3)):
            w[r.randrange(60)] = f"y{r.randrange(10**6)}"
        rows.append((i, " ".join(w), "en"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert Counter(map(tuple, ngramjoin.ngram_join(docs, 4, 85, 100).collect())) == brute_components(rows, 4, 85)


@pytest.mark.parametrize("cells", [1, 500, 1 << 24])
def test_trie_walk_finds_all_overlaps(monkeypatch, cells):
    monkeypatch.setattr(ngramjoin, "CELLS", cells)
    r = np.random.Generator(np.random.PCG64(5))
    counts = r.integers(0, 9, ngramjoin.COUNTERS).astype("<u4")
    for size in (5, 30, 200):
        sets = [np.unique(r.integers(0, size, r.integers(1, 25), dtype=np.uint64)) for _ in range(30)]
        asked = [np.unique(r.integers(0, size, r.integers(1, 25), dtype=np.uint64)) for _ in range(20)]
        least = r.integers(0, 9, (30, 20))
        least[3] = np.iinfo(np.int32).max
        want = [[len(np.intersect1d(a, b)) >= least[i, j] for j, b in enumerate(asked)] for i, a in enumerate(sets)]
        assert ngramjoin.Trie(sets, counts).reach(asked, least).tolist() == want


def test_prefix_is_of_one_total_order():
    r = np.random.Generator(np.random.PCG64(6))
    counts = r.integers(1, 4, ngramjoin.COUNTERS).astype("<u4")
    grams = np.unique(r.integers(0, 2**63, 300, dtype=np.uint64))
    order = sorted(grams.tolist(), key=lambda g: (counts[g & (ngramjoin.COUNTERS - 1)], g))
    for many in (1, 7, 150, 299, 300, 400):
        assert sorted(ngramjoin.first_grams(grams, many, counts).tolist()) == sorted(order[:many])


@pytest.mark.parametrize("bound", [2, 10**6])
def test_blocks_meet_wherever_sizes_can_link(spark, monkeypatch, bound):
    monkeypatch.setattr(ngramjoin, "GROUP", bound)
    r = random.Random(9)
    rows = [(bytes([m]), r.randrange(2), bytes([m, c]), r.randrange(1, 400)) for m in range(4) for c in range(12 * m + 2)]
    dealt = ngramjoin.deal(spark.createDataFrame(rows, "mid binary, kind int, class binary, n int"), 85, 100).collect()
    cells = defaultdict(set)
    for x in dealt:
        cells[bytes(x["class"])].add((x["i"], x["j"]))
    met = 0
    for m, kind, a, n in rows:
        for m2, kind2, b, n2 in rows:
            if a < b and m == m2 and not (kind and kind2) and 100 * min(n, n2) >= 85 * max(n, n2):
                assert cells[a] & cells[b]
                met += 1
    assert met and len(dealt) == len({(bytes(x["class"]), x["i"], x["j"]) for x in dealt})


def test_id_filter_lets_all_through_that_it_holds(spark):
    ids = spark.createDataFrame([(i * i - 40,) for i in range(500)] + [(None,)], "doc_id long")
    bits = np.frombuffer(ngramjoin.id_filter(ids), np.uint8)
    hit = lambda df: [all(bits[a >> 3] >> (a & 7) & 1 for a in r["at"]) for r in df.select(ngramjoin.filter_places("doc_id").alias("at")).collect()]
    assert len(bits) * 8 == ngramjoin.FILTER_BITS and all(hit(ids)) and sum(hit(spark.range(10**6, 10**6 + 3000).withColumnRenamed("id", "doc_id"))) == 0


def test_join_of_nothing(empty):
    assert ngramjoin.ngram_join(empty).count() == 0


def test_one_of_each(docs, rows):
    kept = [tuple(r) for r in ngramjoin.one_of_each(docs).select("doc_id", "text").collect()]
    want = {doc for doc, _, c in brute_components(rows, 5, 80) if doc == c}
    # of the rows under a repeated id, each that is alone in its component stays
    assert {d for d, _ in kept} == want | {None}
    assert len(kept) == len(set(kept)) and Counter(d for d, _ in kept)[306] == 2


def test_one_of_each_goes_by_row(spark):
    """Rows of one id go by their own texts; equal rows leave one, whatever the other columns; null ids come last."""
    w, other = sentence(random.Random(1), 30), sentence(random.Random(2), 30)
    rows = [(1, w, 1), (2, other, 2), (2, w, 3), (3, w, 4), (3, w, 5), (None, w, 6), (None, "alone here", 7), (None, "alone here", 8), (None, None, 9), (4, None, 10), (4, "", 11)]
    kept = {tuple(r)[:2] for r in ngramjoin.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, extra int")).collect()}
    assert kept == {(1, w), (2, other), (None, "alone here"), (None, None), (4, None), (4, "")}
    again = spark.createDataFrame(list(reversed(rows)), "doc_id long, text string, extra int").repartition(4)
    one, two = (sorted(map(tuple, ngramjoin.one_of_each(x).collect()), key=repr) for x in (again, again.repartition(2)))
    assert one == two and len(one) == 6


def test_trie_finds_what_all_pairs_find():
    rng = np.random.default_rng(1)
    for num in (50, 80, 85) * 20:
        base = rng.integers(0, 2**63, 60, dtype=np.uint64)
        sets = [np.unique(np.concatenate([base[rng.random(60) < rng.choice([0.5, 0.9, 0.97, 1])], rng.integers(0, 2**63, rng.integers(1, 8), dtype=np.uint64)])) for _ in range(20)]
        want = [i for i, s in enumerate(sets) if 100 * len(np.intersect1d(s, sets[0])) >= num * len(np.union1d(s, sets[0]))]
        assert sorted(ngramjoin.Trie(sets, np.ones(ngramjoin.COUNTERS, "<u4")).linked(sets[0], num, 100)) == want


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 3), (200, 201), (300, 300)]
    labels, _ = components(spark.createDataFrame(links, "a long, b long"))
    assert {tuple(r) for r in labels.collect()} == {(i, 1) for i in [*range(1, 41), 100]} | {(200, 200), (201, 200)}


# 3 and 9 ------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vectors(spark):
    r = random.Random(8)
    some = [[r.gauss(0, 0.2) for _ in range(16)] for _ in range(300)]
    rows = [(i, v) for i, v in enumerate(some)] + [(1000 + i, some[0]) for i in range(400)]
    rows += [(5000, None), (5001, [None] * 16), (5002, [float("nan")] * 16), (5003, [0.1] * 3), (5004, [0.0] * 16), (None, some[1]), (5, some[5])]
    return rows, spark.createDataFrame([(1, i, v, "x") for i, v in rows], "label int, vec_id long, embedding array<float>, cell string")


def usable(rows):
    return [(i, [float(np.float32(x)) for x in v]) for i, v in rows if i is not None and v is not None and len(v) == 16 and all(x is not None and math.isfinite(x) for x in v)]


def test_topk_is_exact(vectors, monkeypatch):
    monkeypatch.setattr(bitslice, "ROW_BLOCK", 200)
    rows, table = vectors
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in usable(rows)]
    want = []
    for q, a in good:
        if q % 100 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in good if i != q)[:10]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    assert sorted(map(tuple, bitslice.exact_topk(table, table.where("vec_id % 100 = 0"), 10).collect())) == sorted(want)
    assert bitslice.exact_topk(table.limit(0), table.limit(0), 10).count() == 0


def test_topk_of_wide_values(spark):
    rows = [(i, [float((i * 7919 % 101 - 50) * 2**k) for k in range(15)]) for i in range(120)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = bitslice.exact_topk(table, table.where("vec_id = 0"), 5).collect()
    want = sorted((-sum(int(1024 * x) * int(1024 * y) for x, y in zip(rows[0][1], v, strict=True)), i) for i, v in rows[1:])[:5]
    assert [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [(i, -s) for s, i in want]


def test_ann_recall_and_scores(vectors, monkeypatch):
    monkeypatch.setattr(ann, "ROW_BLOCK", 100)
    rows, table = vectors
    good = [(i, np.array(v)) for i, v in usable(rows) if any(v)]
    got = defaultdict(list)
    for r in ann.ann(table, table.where("vec_id % 50 = 0"), 5).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    hits = total = 0
    for q, a in good:
        if q % 50 == 0:
            true = sorted((-(a @ b) / (np.linalg.norm(a) * np.linalg.norm(b)), i) for i, b in good if i != q)[:5]
            found = sorted(got[q])
            assert [n for n, _, _ in found] == list(range(1, len(found) + 1))
            near = {i: -s for s, i in true}
            hits += sum(s >= -true[-1][0] - 1e-12 for _, _, s in found)
            total += len(true)
            for _, i, s in found:
                assert i != q and (i not in near or abs(near[i] - s) < 1e-12)
    assert hits >= 0.9 * total
    assert ann.ann(table.limit(0), table.limit(0)).count() == 0


def test_vectors_of_other_lengths_take_no_part(spark):
    """One length for both sides, the table's most common; a repeated query asks for its first vector in order."""
    r = random.Random(4)
    rows = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(60)] + [(100 + i, [1.0, 2.0, 3.0]) for i in range(40)]
    rows += [(200, [1.0] * 8), (200, [-1.0] * 8), (300, [0.5] * 8)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = table.where("vec_id >= 100").unionByName(spark.createDataFrame([(7, None), (8, [0.1] * 5)], table.schema))
    top = bitslice.exact_topk(table, queries, 3).collect()
    assert {(x["query_id"], x["rank"]) for x in top} == {(q, n) for q in (200, 300) for n in (1, 2, 3)} and len(top) == 6
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if len(v) == 8]
    for q, v in ((200, [-1024] * 8), (300, [512] * 8)):
        want = sorted((-sum(a * b for a, b in zip(v, x, strict=True)), i) for i, x in whole if i != q)[:3]
        assert [(x["vec_id"], x["score"]) for x in sorted(top, key=lambda x: x["rank"]) if x["query_id"] == q] == [(i, -s) for s, i in want]
    near = ann.ann(table, queries, 3).collect()
    assert {(x["query_id"], x["rank"]) for x in near} == {(q, n) for q in (200, 300) for n in (1, 2, 3)} and len(near) == 6
    assert all(x["vec_id"] < 100 or x["vec_id"] >= 200 for x in top + near)


def test_ann_probes_on_until_it_has_enough(spark):
    """Tight clusters smaller than k, and a query id that many rows repeat: every query still gets its k."""
    r = random.Random(6)
    rows, i = [], 0
    for _ in range(150):
        centre = [r.gauss(0, 1) for _ in range(12)]
        for _ in range(r.choice([1, 2, 3, 40])):
            rows.append((i, [c + r.gauss(0, 1e-3) for c in centre]))
            i += 1
    rows += [(10**6, rows[0][1])] * 50
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = Counter(x["query_id"] for x in ann.ann(table, table, 5).collect())
    assert set(got.values()) == {5} and len(got) == i + 1
    few = table.where("vec_id < 4")
    assert Counter(x["query_id"] for x in ann.ann(few, few, 5).collect()) == {n: 3 for n in range(4)}


# 4 ------------------------------------------------------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    return {
        "email": [m.span() for m in EMAIL.finditer(t)],
        "ip": [m.span() for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))],
        "card": [m.span() for m in CARD.finditer(t) if 13 <= len(digits(m)) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits(m)))) % 10 == 0],
        "phone": [m.span() for m in PHONE.finditer(t) if 9 <= len(digits(m)) <= 15],
    }


@given(st.text(alphabet="ab.@+-01 4(%é\n", max_size=60))
@settings(max_examples=500, deadline=None)
def test_base_spans_are_the_patterns(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_cards_and_addresses():
    t = "pay 4111 1111 1111 1111 to a.b+c@x-y.co.uk from 10.0.0.256 or 10.0.0.25, call +1 (456) 555-2186"
    assert {k: [t[a:b] for a, b in v] for k, v in pii.base_spans(t).items()} == {"email": ["a.b+c@x-y.co.uk"], "ip": ["10.0.0.25"], "card": ["4111 1111 1111 1111"], "phone": ["+1 (456) 555-2186"]}


@pytest.mark.parametrize(
    ("text", "kind", "span"),
    [
        ("mail jоhn.doe@exаmple.com now", "email", "jоhn.doe@exаmple.com"),
        ("write bob (at) mail [dot] example dot com please", "email", "bob (at) mail [dot] example dot com"),
        ("bob at example dot com", "email", "bob at example dot com"),
        ("call plus one five five five one two three four five six seven ok", "phone", "plus one five five five one two three four five six seven"),
        ("＋１ ４１５ ５５５ １２３４ end", "phone", "＋１ ４１５ ５５５ １２３４"),
        ("host 10[dot]0[dot]0[dot]7 up", "ip", "10[dot]0[dot]0[dot]7"),
        ("a​b@x​.org", "email", "a​b@x​.org"),
    ],
)
def test_disguises_map_back(text, kind, span):
    base, found = pii.all_spans(text)
    assert [text[a:b] for a, b in found[kind]] == [span] and (text.index(span), text.index(span) + len(span)) not in base[kind]
    assert span not in pii.redact(text) and f"<{kind.upper()}>" in pii.redact(text)


@pytest.mark.parametrize(
    ("text", "kind", "span"),
    [
        ("call plus 49 30 1234567", "phone", "plus 49 30 1234567"),
        *((f"ask {x} now", "email", x) for x in ("bob { at } example.com", "bob < at > example.com", "bob [ @ ] example.com", "bob (\tat ) example.com", "bob <  @> example.com")),
        *((f"host {x} up", "ip", x) for x in (f"10{o}{w}{s}0{o}{w}{s}0{o}{w}{s}7" for w in ("dot", "punto", "punkt", "point") for o, s in (("{", "}"), ("< ", " >"), ("[\t", "]"), (" (  ", ") ")))),
        ("host 192.168.0.seven up", "ip", "192.168.0.seven"),
        ("fax +1 415 555 one two", "phone", "+1 415 555 one two"),
        ("fax +1 415 555 1 \u017fIX", "phone", "+1 415 555 1 \u017fIX"),
        ("pay \uff14111 1111 1111 1111 one by one", "card", "\uff14111 1111 1111 1111"),
        ("pay 4111 1111 1111 111 one", "card", "4111 1111 1111 111 one"),
        ("ask john at example.com now", "email", "john at example.com"),
        ("ask bob at mail.example dot com now", "email", "bob at mail.example dot com"),
        ("call +1 five five five 123 4567 now", "phone", "+1 five five five 123 4567"),
        ("pide a ana (arroba) correo (punto) es hoy", "email", "ana (arroba) correo (punto) es"),
        ("bob[at]example[.]com", "email", "bob[at]example[.]com"),
    ],
)
def test_each_disguise_alone(text, kind, span):
    assert [text[a:b] for a, b in pii.all_spans(text)[1][kind]] == [span]


@pytest.mark.parametrize("label", ["it", "in", "kr", "me", "za", "ie"])
def test_country_labels(label):
    text = f"ask jane at example dot {label}, please"
    assert [text[a:b] for a, b in pii.all_spans(text)[1]["email"]] == [f"jane at example dot {label}"]
    assert not any(pii.all_spans(f"look at the dot {label} or at every dot {label}")[1].values())


@pytest.mark.parametrize("words", ["null eins zwei drei vier fünf sechs sieben acht neun", "zéro un deux trois quatre cinq six sept huit neuf", "cero uno dos tres cuatro cinco seis siete ocho nueve"])
def test_digits_of_other_languages(words):
    text = f"tel. plus {words}."
    assert [text[a:b] for a, b in pii.all_spans(text)[1]["phone"]] == [f"plus {words}"]
    assert [pii.digit_of(w) for w in words.upper().split()] == list("0123456789")


@pytest.mark.parametrize("text", ["", "look at the dot in one two three", "we met at noon", "zero one two three four five six seven", "naïve café à 3 euros", "version 1.2.3", "visit us at example.com", "Look at amazon.com today", "see more at x.org", "they met at noon. It rained"])
def test_clean_text_is_left_alone(text):
    assert not any(pii.all_spans(text)[1].values()) and pii.redact(text) == text


@pytest.mark.parametrize("text", ["see [at ", "x at", "[ ", "one ", "a at ", "at dot ", "(", " ", "plus ", "a.", "five-", "1.", "+1 ", "a@"])
def test_long_runs_are_read_in_linear_time(text):
    """A million characters of a run, and of one blank run, take seconds; a quadratic pass would take hours."""
    began = time.monotonic()
    pii.all_spans(text * (10**6 // len(text)))
    pii.all_spans(text + " " * 10**6 + text)
    assert time.monotonic() - began < 20


@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=40))
@settings(max_examples=300, deadline=None)
def test_any_text_keeps_its_base_spans(text):
    base, found = pii.all_spans(text)
    assert base == plain_spans(text) and all(set(base[k]) <= set(found[k]) for k in base)


def test_pii_rows(docs, rows, empty):
    got = Counter((r["doc_id"], r["n_card"], r["base_sha256"]) for r in pii.find_pii(docs).collect())
    say = lambda t: ",".join(f"{k}:{a}:{b}" for k, v in plain_spans(t or "").items() for a, b in v)
    assert got == Counter((i, len(plain_spans(t or "")["card"]), hashlib.sha256(say(t).encode()).hexdigest()) for i, t, _ in rows)
    assert pii.find_pii(empty).count() == 0
    assert pii.redact_pii(docs).columns == docs.columns and pii.redact_pii(docs).where("text IS NULL").count() == 1


# 5 and 6 ------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)


def test_token_counts(docs, rows, library, empty):
    got = Counter(map(tuple, tokencounts.token_counts(docs, PIECE_BPE).collect()))
    count = lambda t: len(library.encode(t or ""))
    assert got == Counter((i, len((t or "").encode()), count(t), count(t) > 4096) for i, t, _ in rows)
    assert tokencounts.token_counts(empty, PIECE_BPE).count() == 0
    json = {r["doc_id"]: r["n_tokens"] for r in tokencounts.token_counts(docs.where("doc_id = 303"), WORD_BPE).collect()}
    assert json == {303: 2}


def test_calls_are_bounded_for_one_text_as_for_many():
    texts = ["word " * 300_000, "x", "", "é" * 10, "y" * (1 << 21), "z " * 5]
    parts = [(i, p) for i, t in enumerate(texts) for p in tokencounts.safe_parts(t)]
    made = list(tokencounts.calls(iter(parts)))
    assert [(o, t) for owners, some in made for o, t in zip(owners, some, strict=True)] == parts
    sizes = [sum(len(t.encode()) for t in some) for _, some in made]
    assert len(made) > 2 and all(size <= tokencounts.BATCH or len(some) == 1 for size, (_, some) in zip(sizes, made, strict=True))
    assert sum(size > tokencounts.BATCH for size in sizes) == 1  # the text without a safe boundary


@pytest.mark.parametrize("change", ["charsmap", "prefix", "suffix", "piece"])
def test_models_that_normalise_get_whole_texts(tmp_path, change):
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(PIECE_BPE, "rb") as f:
        model.ParseFromString(f.read())
    if change == "charsmap":
        model.normalizer_spec.normalization_rule_tsv = "x"
    elif change == "prefix":
        model.normalizer_spec.add_dummy_prefix = False
    elif change == "suffix":
        model.trainer_spec.treat_whitespace_as_suffix = True
    else:
        model.pieces[500].piece = "a▁b"
    path = tmp_path / "own.model"
    path.write_bytes(model.SerializeToString())
    assert not tokencounts.counter(str(path))[1]


@given(st.one_of(st.text(max_size=60), st.text(alphabet="the'sSTRE \n\t19éÉßİſ漢.,<|endoftx>-\u0301\u200b\u00a0", max_size=60)))
@settings(max_examples=500, deadline=None)
def test_words_are_the_librarys(text):
    from docloom.llm.wordids import encoder

    coder = encoder(WORD_BPE)
    ids = coder.words.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(coder.encode([text])[0], coder.dtype).tolist() == ids


def test_operators_forget_each_others_tables():
    """A worker process serves all stages of a pipeline: what one has kept must not lie beside the tables of the next."""
    from docloom.llm import wordids

    texts = pa.RecordBatch.from_pydict({"lang": ["en"], "text": ["one two three four five six"], "row": [b"r"]})
    ids = texts.set_column(0, "doc_id", pa.array([1], pa.int64()))
    held = lambda: (bool(wordids._ENCODERS), wordhash.POWERS.kept is not None)
    for stage, own in ((lambda: ngramjoin._classes(5)(iter([ids])), True), (lambda: langid._count(iter([texts])), False)):
        wordids.encoder(WORD_BPE).encode(["one two"])
        wordhash.POWERS.upto(1)
        assert held() == (True, True)
        assert list(stage()) and held() == (False, own)


def test_trimmed_passes_all_on_and_then_gives_memory_back(monkeypatch):
    seen = []
    monkeypatch.setattr(common, "release", lambda: seen.append("released"))

    def run(batches):
        for b in batches:
            seen.append(b)
            yield 2 * b

    assert list(common.trimmed(run)(iter([1, 2]))) == [2, 4] and seen == [1, 2, "released"]
    assert not list(common.trimmed(run)(iter([]))) and seen[3:] == ["released"]


def test_other_tokenizers_get_whole_texts():
    from docloom.llm.wordids import by_word, encoder

    path = public_tokenizers.path("byte_bpe_50k.json")
    coder = encoder(path)
    assert by_word(WORD_BPE) and not by_word(path)
    texts = ["Hello  World\n\n's", "", None, "a <|endoftext|> b"]
    want = [coder.words.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, coder.dtype).tolist() for x in coder.encode(texts)] == want


@pytest.mark.parametrize("most", [7, 50, 1 << 20])
def test_long_texts_hash_like_their_words(most):
    r = random.Random(1)
    text = "".join(r.choice("abÉ \n\t漢") for _ in range(2000)) + "x" * 300 + " end"
    column = pa.array(["short one", text, "", "tail"], pa.large_string())
    got = {i + n: words[a:b].tolist() for i, words, at in wordhash.word_batches(column, most) for n, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True))}
    want = {i: words[at[0] : at[1]].tolist() for i in range(4) for words, at in [wordhash.hash_words(*common.buffers(column.slice(i, 1)))]}
    assert got == want and len(got[1]) == len(re.findall(r"[^ \n\t]+", text))


@given(st.text(alphabet="ab ▁\ncé漢.", max_size=80), st.integers(2, 20))
@settings(max_examples=300, deadline=None)
def test_cut_texts_count_the_same(text, most):
    count, cuttable = tokencounts.counter(PIECE_BPE)
    assert cuttable and sum(count(tokencounts.safe_parts(text, most))) == count([text])[0]


@given(st.one_of(st.text(max_size=40), st.text(alphabet="the ing▁\n.,AB漢é", max_size=60)))
@settings(max_examples=400, deadline=None)
def test_pieces_are_the_librarys(text):
    c = pieces.coder(PIECE_BPE)
    ids = c.library.encode(text)
    assert np.frombuffer(c.encode([text])[0], "<u4").tolist() == ids
    assert c.decode(np.array(ids, np.uint32)) == c.library.decode(ids)


def test_unigram_pass_is_viterbi(tmp_path):
    """The same vocabulary with scores as a Unigram model, against the library's own Viterbi."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(PIECE_BPE, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    for p in model.pieces:
        if p.type == 1:
            p.score = -math.log(2 + abs(p.score)) - 0.001 * len(p.piece)
    path = tmp_path / "unigram.model"
    path.write_bytes(model.SerializeToString())
    c = pieces.PieceCoder(str(path))
    for text in ("the quick brown fox", "internationalization of documents", "abc  def"):
        ids = np.frombuffer(c.encode([text])[0], "<u4").tolist()
        score = lambda x: sum(c.scores[i] for i in x)
        assert score(ids) == pytest.approx(score(c.library.encode(text)), abs=1e-4)
        assert c.decode(np.array(ids)) == text


def test_pieces_rows(docs, rows, library, empty):
    coded = pieces.encode(docs, PIECE_BPE)
    back = Counter((r["doc_id"], r["text"]) for r in pieces.decode(coded, PIECE_BPE).collect())
    assert back == Counter((i, t or "") for i, t, _ in rows)
    assert sum(r["n_tokens"] for r in coded.collect()) == sum(len(library.encode(t or "")) for _, t, _ in rows)
    assert pieces.decode(pieces.encode(empty, PIECE_BPE), PIECE_BPE).count() == 0


# 7 ------------------------------------------------------------------------------------------------------


def test_languages_held_out(spark, empty):
    r = random.Random(2)
    sound = {"aa": "abra cada bra sala mal", "ee": "ente mente rede sel fele", "oo": "ono rondo bosco loto"}
    rows = [(i, " ".join(r.choice(sound[g].split()) for _ in range(8)), g) for i, g in enumerate(r.choice([*sound]) for _ in range(400))]
    rows += [(900, None, "aa"), (901, "123 ...", "ee"), (902, "", None), (None, "abra cada", "aa"), (903, "rondo", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    got = {r["doc_id"]: r for r in langid.langid(docs).collect()}
    held = [i for i, _, _ in rows[:400] if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i, x in got.items() if x["held_out"]} == {i for i, _, _ in rows if i is not None and zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(got[i]["lang_pred"] == rows[i][2] for i in held) >= 0.97 * len(held)
    assert [got[i]["lang_pred"] for i in (900, 901, 902, None, 903)] == ["und", "und", "und", "aa", "oo"]
    assert all(0 <= x["score"] <= 1 for x in got.values())
    assert langid.langid(empty).count() == 0
    assert sorted(r["doc_id"] for r in langid.keep_identified(docs).where("doc_id >= 900").collect()) == [903]
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.langid(unlabelled).collect()} == {"und"}


def test_predictions_are_cosines_of_bundles(spark):
    """Against vectors formed one by one: every trigram bound, every text and language bundled, cosines compared."""
    r = random.Random(3)
    words = {g: [f"{a}{b}{c}" for a in x for b in y for c in x] for g, x, y in (("p", "bdgk", "ae"), ("q", "mnlr", "io"), ("s", "tszf", "uy"))}
    rows = [(i, " ".join(r.choice(words[g if r.random() < 0.7 else r.choice("pqs")]) for _ in range(r.randrange(1, 30))), g) for i, g in enumerate(r.choice("pqs") for _ in range(200))]
    rows += [(5, rows[5][1], rows[5][2]), (900, "b" * 3, None), (901, "Ünï çödé", None)]
    letters = langid.letter_vectors(langid.DIMENSIONS, 7).astype(float)

    def bundle(text):
        symbols = [0, *(int(langid.letter_table()[ord(c)]) for c in text), 0]
        total = np.zeros(langid.DIMENSIONS)
        for a, b, c in zip(symbols, symbols[1:], symbols[2:], strict=False):
            if b:
                total += np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]
        return total

    known = {g: sum(bundle(t) for i, t, x in rows if x == g and zlib.crc32(str(i).encode()) % 4 != 2) for g in "pqs"}
    want = []
    for i, t, _ in rows:
        v = bundle(t)
        cosines = {g: v @ k / np.linalg.norm(v) / np.linalg.norm(k) for g, k in known.items()}
        best = max(sorted(cosines), key=cosines.get)
        positive = sum(max(x, 0) for x in cosines.values())
        want.append((i, best, round(cosines[best] / positive, 9) if positive else 0.0))
    got = langid.langid(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).collect()
    assert sorted((x["doc_id"], x["lang_pred"], round(x["score"], 9)) for x in got) == sorted(want)


@given(st.lists(st.text(alphabet="abÉß \n1漢", max_size=30), max_size=5), st.integers(1, 12))
@settings(max_examples=200, deadline=None)
def test_trigrams_of_parts_are_those_of_the_whole(texts, most):
    [(codes, owner)] = langid.trigrams(texts)
    parts = list(langid.trigrams(texts, most))
    assert np.array_equal(np.concatenate([c for c, _ in parts]), codes) and np.array_equal(np.concatenate([o for _, o in parts]), owner)


def test_bundles_are_linear():
    letters = langid.letter_vectors(64, 1)
    [(codes, owner)] = langid.trigrams(["Ab c", "ß"])
    assert owner.tolist() == [0, 0, 0, 1]
    a, b = (langid.letter_table()[ord(c)] for c in "ab")
    assert codes[0] == (0 * 64 + a) * 64 + b
    assert np.array_equal(langid.bind(codes[:1], letters)[0], np.roll(letters[0], 2) * np.roll(letters[a], 1) * letters[b])


# 8 ------------------------------------------------------------------------------------------------------


def test_language_model_base_is_exact(docs, rows, empty):
    words = [[*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), None] for _, t, _ in rows]
    rest = [None if i is None else zlib.crc32(str(i).encode()) % 7 for i, _, _ in rows]
    c = Counter(w for ws, m in zip(words, rest, strict=True) if m not in (None, 2) for w in ws)
    n, v = sum(c.values()), len(c)
    want = Counter((i, m == 2, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for (i, _, _), ws, m in zip(rows, words, rest, strict=True))
    scored = bloomlm.score_texts(docs).collect()
    assert Counter((*r[:5], round(r["base_score"], 6)) for r in scored) == want
    assert all(math.isfinite(r["score"]) and r["score"] <= 0 for r in scored)
    assert bloomlm.score_texts(empty).count() == 0


def test_language_model_scores_are_its_formula(docs, rows):
    """Against exact bigram counts, quantised alike: only the filter's few false positives differ."""
    words = [[*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), None] for _, t, _ in rows]
    learn = [ws for (i, _, _), ws in zip(rows, words, strict=True) if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    c, pairs = Counter(w for ws in learn for w in ws), Counter(p for ws in learn for p in zip([None, *ws], ws, strict=False))
    total = sum(c.values()) + len(c) + 1
    level = {n: float(bloomlm.count_of(bloomlm.levels_of([n]))[0]) for n in {0, *c.values(), *pairs.values()}}

    def score(ws):
        probability = lambda v, w: (level[pairs[v, w]] + bloomlm.ALPHA * (level[c[w]] + 1) / total) / (level[c[v]] + bloomlm.ALPHA)
        return sum(math.log10(min(1.0, probability(v, w))) for v, w in zip([None, *ws], ws, strict=False))

    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"], r["score"]) for r in bloomlm.score_texts(docs).collect())
    want = sorted((i is not None, i or 0, len(ws), score(ws)) for (i, _, _), ws in zip(rows, words, strict=True))
    assert [x[:3] for x in got] == [x[:3] for x in want]
    off = np.array([abs(a[3] - b[3]) / b[2] for a, b in zip(got, want, strict=True)])
    assert off.mean() < 0.01 and np.median(off) < 0.005 and (off < 1e-9).sum() > len(off) / 4


def test_language_model_counts_bigrams_of_rare_words(spark):
    r = random.Random(8)
    train = [f"{a} {b}" for a, b in (r.sample([f"w{k}" for k in range(20_000)], 2) for _ in range(20_000))] + ["rare pair"] * 3 + ["rare else", "other pair"]
    ids = iter(i for i in range(10**6) if zlib.crc32(str(i).encode()) % 7 != 2)
    rows = [(next(ids), t) for t in train]
    held = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    rows += [(held[0], "rare pair"), (held[1], "other else")]  # no word makes up a ten-thousandth of the tokens
    got = {r["doc_id"]: r for r in bloomlm.score_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    c = Counter(w for t in train for w in [*t.split(), None])
    pairs = Counter(p for t in train for p in zip([None, *t.split()], [*t.split(), None], strict=True))
    total, back = sum(c.values()) + len(c) + 1, lambda n: float(bloomlm.count_of(bloomlm.levels_of([n]))[0])
    for i, t in rows[-2:]:
        p = [(back(pairs[v, w]) + bloomlm.ALPHA * (back(c[w]) + 1) / total) / (back(c[v]) + bloomlm.ALPHA) for v, w in zip([None, *t.split()], [*t.split(), None], strict=True)]
        assert got[i]["score"] == pytest.approx(sum(map(math.log10, p)), abs=1e-9)
    assert got[held[0]]["score"] > got[held[1]]["score"] + 1


def test_filter_gives_levels_back():
    rng = np.random.default_rng(4)
    keys = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    levels = rng.integers(1, 12, 4000)
    import pyarrow as pa

    part = pa.RecordBatch.from_arrays([pa.array(bloomlm.segment_of(keys).astype(np.int32)), pa.array(keys.view(np.int64)), pa.array(levels.astype(np.int32))], names=["segment", "key", "level"])
    whole = np.zeros((bloomlm.SEGMENTS, bloomlm.SEGMENT_BITS // 8), np.uint8)
    for b in bloomlm._fill(iter([part])):
        whole[b.column(0)[0].as_py()] |= np.frombuffer(b.column(1)[0].as_py(), np.uint8)
    found = bloomlm.Filter(whole.ravel())
    got = found.levels(keys)
    assert (got >= levels).all() and (got == levels).mean() > 0.999  # never too low
    assert (found.levels(rng.integers(0, 2**63, 4000, dtype=np.uint64)) == 0).mean() > 0.999
    assert bloomlm.count_of(bloomlm.levels_of([0, 1, 2, 1000]))[[0, 1]].tolist() == [0, 1]


@pytest.mark.parametrize("n", [3, 2000, 200_000])
def test_filter_grows_with_its_entries(n):
    rng = np.random.default_rng(6)
    keys, counts = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)), rng.integers(1, 60, n)
    found, levels = bloomlm.segment_filter(keys, counts), bloomlm.levels_of(counts)
    assert len(found.bits) * 8 >= bloomlm.ENTRY_BITS * levels.sum()
    got = found.levels(keys)
    assert (got >= levels).all() and got.max() <= levels.max()
    assert n < 2000 or (got == levels).mean() > 0.99
    assert n < 2000 or (found.levels(rng.integers(0, 2**63, 100_000, dtype=np.uint64)) > 0).mean() < 0.01
    full = bloomlm.Filter(np.full(1 << 10, 255, np.uint8), 1, 5)
    assert (full.levels(keys) == 5).all()  # a full filter ends at its highest level
    assert bloomlm.segment_filter(keys[:0], counts[:0]).levels(keys).max() == 0


# 10 -----------------------------------------------------------------------------------------------------


def best_fit_decreasing(counts, capacity):
    rooms = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [i for i, room in enumerate(rooms) if room >= length]
            if fits:
                rooms[min(fits, key=lambda i: rooms[i])] -= length
            else:
                rooms.append(capacity - length)
    return sorted(rooms)


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=15))
@settings(max_examples=300, deadline=None)
def test_plan_is_best_fit_decreasing(counts):
    steps, sequences = packing.plan_packing(counts, 40)
    used = defaultdict(list)
    for length, first_, end, sequence, per, offset in steps.tolist():
        for k in range(end - first_):
            used[sequence + k // per].append((offset + k % per * length, length))
    assert Counter(n for v in used.values() for _, n in v) == Counter(counts)
    for v in used.values():
        at = 0
        for offset, n in sorted(v):
            assert offset == at
            at += n
        assert at <= 40
    assert len(used) == sequences
    assert sorted(40 - sum(n for _, n in v) for v in used.values()) == best_fit_decreasing(counts, 40)


def test_packing_rows(docs, rows, word_bpe, empty):
    got = packing.pack(docs, WORD_BPE, capacity=512).collect()
    want = Counter()
    for i, t, _ in rows:
        ids = word_bpe(t)
        for p, at in enumerate(range(0, len(ids), 512)):
            want[i, p, at, len(ids[at : at + 512]), ids[at : at + 512].tobytes()] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], bytes(r["ids"])) for r in got) == want
    assert all(r["ids_crc32"] == zlib.crc32(bytes(r["ids"])) for r in got)
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for v in by.values():
        ends = np.cumsum([n for _, n in sorted(v)])
        assert [o for o, _ in sorted(v)] == [0, *ends[:-1].tolist()] and ends[-1] <= 512
    assert packing.pack(empty, WORD_BPE).count() == 0


# the pipeline -------------------------------------------------------------------------------------------


def expected_pipeline(documents, word_bpe):
    """The pipeline by brute force: (doc_id, piece, start, length, ids) of every piece; languages are only told apart from none."""
    told = [r for r in documents if any(c.isalpha() for c in r["text"] or "")]
    member = {}
    for r, (_, _, c) in zip(told, brute_members([(r["doc_id"], r["text"], None) for r in told], 5, 80), strict=True):
        key = (r["doc_id"] is None, r["doc_id"] or 0, hashlib.md5(f"{'?' if r['doc_id'] is None else r['doc_id']}+{r['text']}".encode()).digest())
        member[c] = min(member.get(c, (key, r)), (key, r), key=lambda x: x[0])
    want = Counter()
    for _, r in member.values():
        ids = word_bpe(pii.redact(r["text"]))
        for p, at in enumerate(range(0, len(ids), 4096)):
            want[r["doc_id"], p, at, len(ids[at : at + 4096]), ids[at : at + 4096].tobytes()] += 1
    return want


def brute_members(rows, k, num):
    """(doc_id, size, component number) of each row."""
    sets = [grams(t, k) for _, t, _ in rows]
    at = list(range(len(rows)))

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                at[find(a)] = find(b)
    return [(doc, len(sets[i]), find(i)) for i, (doc, _, _) in enumerate(rows)]


def test_pipeline(spark, docs, tmp_path, word_bpe):
    """Every row against brute force: who stays, what is redacted, each piece's ids, sequences without gaps; odd rows and all."""
    import corpus_pipeline

    path = f"file://{tmp_path}"
    personal = [(2000 + i, f"{sentence(random.Random(i), 12)} mail jo{i}@x.org or ann (at) y{i} dot com, 10.0.0.{i}", "en", "s", 1) for i in range(5)]
    documents = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(personal, "doc_id long, text string, lang string, source string, n_chars long"))
    documents.write.parquet(f"{path}/documents.parquet")
    out = corpus_pipeline.run(spark, path).collect()
    got = Counter((r["doc_id"], r["piece"], r["start"], r["length"], bytes(r["ids"])) for r in out)
    assert got == expected_pipeline(documents.collect(), word_bpe)
    by = defaultdict(list)
    for r in out:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
        assert r["ids_crc32"] == zlib.crc32(bytes(r["ids"]))
    for v in by.values():
        ends = np.cumsum([n for _, n in sorted(v)])
        assert [o for o, _ in sorted(v)] == [0, *ends[:-1].tolist()] and ends[-1] <= 4096
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "pii", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, documents, path).columns == documents.columns


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_no_shared_folder_on_a_cluster_is_refused():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match="share"):
        common.shared_dir(Session())


def test_settings_stay_as_they_were(spark, docs):
    names = (common.CLEANUP, "spark.sql.execution.arrow.maxRecordsPerBatch")
    before = [spark.conf.get(n) for n in names]
    bloomlm.score_texts(docs).count()
    assert [spark.conf.get(n) for n in names] == before


def test_tokenizers_are_installed():
    assert public_tokenizers.path("word_bpe_49k.json") == WORD_BPE
