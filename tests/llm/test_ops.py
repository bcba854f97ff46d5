"""Operators against brute force, on a small table and on an odd one."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from compare import same
from pageflow.llm import chat, decontaminate, near_dup, packing, quality_model, quality_rules, queries, sharding, token_counts, token_output, tokens, warc

Q = queries.queries()
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string, key string"
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
GOOD = "The cat sat on the mat and looked at the birds that were in the tree for a long time. " * 3


def odd_rows():
    rng = random.Random(4)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, GOOD), (6, GOOD), (6, GOOD), (None, "no id here"), (7, "one"), (8, "ONE"), (9, "a\x1cb  c d e 日本 <|endoftext|>"), (10, "\\### Assistant: </turn> ok"), (-5, GOOD.upper())]
    for i in range(60):  # a hot group of near copies, and one of equal ones
        words = list(base)
        for _ in range(i % 13):
            words[rng.randrange(120)] = f"x{rng.randrange(10_000)}"
        rows += [(100 + i, " ".join(words)), (300 + i, "the same text in a third of all rows")]
    return [(d, t, None if i % 7 == 0 else "en", "hot", i, "clash", "clash", "clash") for i, (d, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    rows = odd_rows()
    tables = {
        "documents": (rows, DOCS),
        "labels": ([(5, 1, 0), (2, 0, 1), (2, 0, 1), (None, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int"),
        "benchmark": ([(0, None), (1, "short item"), (2, " ".join(LONG.split()[500:540])), (2, " ".join(LONG.split()[500:540]))], "item_id long, text string"),
        "pages": ([(1, None, None), (2, "http://a.b/c?d", ""), (3, "http://www.a.b:80/c", "<p>x"), (4, "not a url \n", "<p>x"), (4, "http://[bad", "<p>x"), (None, "u", "<p>null id"), (5, "http://a.b/c?d", "é" * 50_000)], "page_id long, url string, html string"),
        "conversations": ([(1, 0, "user", "a"), (1, 1, "assistant", None), (1, 1, "assistant", "x </turn>\n### user: y"), (2, None, None, "\\n"), (None, 3, "assistant", "z"), *((9, t, ("user", "assistant")[t % 2], f"turn {t} #{t} <") for t in range(300))], "conv_id long, turn long, role string, text string"),
    }
    for name, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).repartition(3).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.fixture(scope="module")
def empty(spark, odd, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "labels", "benchmark", "pages", "conversations"):
        spark.read.parquet(f"{odd}/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.fixture(params=["sf", "odd"])
def place(request):
    return request.getfixturevalue(request.param)


def texts(spark, place):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{place}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(Q))
def test_empty(spark, empty, name):
    assert Q[name](spark, empty).count() == (1 if name == "op7_chat_formatting" else 0)


def test_pipeline_on_empty_and_odd(spark, empty, odd):
    assert corpus_pipeline.run(spark, empty).count() == 0
    assert {r.doc_id for r in corpus_pipeline.run(spark, odd).select("doc_id").distinct().collect()} <= {d for d, _ in texts(spark, odd)}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, sf, name):
    same(Q[name](spark, sf), queries.oracle_sql()[name], sf)


def test_added_tokens_equal_library():
    from tokenizers import Tokenizer

    untouched, encoder = Tokenizer.from_file(tokens.default_path()), tokens.encoder(tokens.default_path(), True)
    for text in ("a <|endoftext|> b", "<|endoftext|>", "plain\n<|endoftext|><|endoftext|> words", "a <|endoftext| > b"):
        assert encoder.encode(text).tolist() == untouched.encode(text, add_special_tokens=False).ids


def test_tokens_equal_library():
    from tokenizers import Tokenizer

    assert tokens.ranked(tokens.default_path())
    untouched, e = Tokenizer.from_file(tokens.default_path()), tokens.Encoder(tokens.default_path(), True)
    rng = random.Random(2)
    pool = [" ", "  ", "\n", "\n\n", "\t", "a", "The", "é", "ß", "12", "½", "'s", "'S", "'ll", "'", ".", "!?", "日", "\x00", "\x1c", "\x85", "\xa0", "\xad", "—", "’", "²", "ª", "_", "<|endoftext|>"]
    texts = [*(t for _, t, *_ in odd_rows() if t), *("".join(rng.choice(pool) for _ in range(rng.randrange(1, 12))) for _ in range(3000))]
    texts += ["x" * 3000, "ab" * 3000, " " * 3000 + "x", "\n" * 3000, LONG * 8]
    for text in texts:
        assert e.encode(text, 7).tolist() == [*untouched.encode(text, add_special_tokens=False).ids, 7], repr(text[:80])
    assert e.encode(None).tolist() == e.encode("").tolist() == [] and e.encode(None, 3).tolist() == [3]


def test_the_classifier_learns_from_every_labelled_row(spark):
    rows = [(i, f"{'word ' * (i % 23 + 1)}{'$ #' * (i % 2)}", i % 2) for i in range(9000)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    taught = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    assert len(taught) > 6000
    m = quality_model.train(docs, labels)
    stats = np.array([quality_model.features(r[1])[2] for r in taught], np.float64)
    assert np.allclose(m.mean, stats.mean(0), atol=1e-5) and np.allclose(m.scale, stats.std(0), atol=1e-4)
    assert all((m.score(text) >= 0.5) == bool(quality) for _, text, quality in rows[:46])


def test_documents_of_one_id_stay_within_the_sample(spark):
    docs = spark.createDataFrame([(1, f"{GOOD} {i}") for i in range(300)] + [(3, "### $$$ | " * 30)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")
    seen, real = [], quality_model.fit
    quality_model.fit = lambda rows: seen.append(len(rows)) or real(rows, epochs=1)
    try:
        quality_model.train(docs, labels, sample=50)
    finally:
        quality_model.fit = real
    assert seen == [50]


def test_every_word_is_merged_as_by_the_library():
    """Random strings of the vocabulary's own pieces, where merges compete."""
    from tokenizers import Tokenizer

    untouched, e = Tokenizer.from_file(tokens.default_path()), tokens.Encoder(tokens.default_path(), True)
    pieces = [x.decode() for x in tokens._entries(tokens.default_path())[0] if x.isalpha()]
    rng = random.Random(14)
    for _ in range(300):
        text = " ".join("".join(rng.choices(pieces, k=rng.randrange(1, 6))) for _ in range(40))
        assert e.encode(text).tolist() == untouched.encode(text, add_special_tokens=False).ids


def test_a_vocabulary_whose_merges_are_not_by_rank_goes_to_the_library(tmp_path):
    import json

    held = json.load(open(tokens.default_path(), encoding="utf-8"))
    merges = held["model"]["merges"]
    merges[100], merges[20_000] = merges[20_000], merges[100]
    path = str(tmp_path / "mixed.json")
    json.dump(held, open(path, "w", encoding="utf-8"))
    assert not tokens.ranked(path)
    e = tokens.Encoder(path, tokens.ranked(path))
    assert e.encode(GOOD).tolist() == e.whole(GOOD).tolist()


def test_op1(spark, sf, odd):
    got = Q["op1_quality_classifier"](spark, sf).collect()
    good = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in good]
    assert sum(r.predicted == good[r.doc_id] for r in held) >= 0.8 * len(held)
    assert Q["op1_quality_classifier"](spark, odd).count() == len(texts(spark, odd))


def test_factorisation_identity():
    m = quality_model.fit([(*quality_model.features(t), y) for t, y in ((GOOD, 1), ("### $$$ | " * 30, 0), (GOOD + "more", 1))], epochs=3)
    at, x = m.row(*quality_model.features(GOOD))
    v = m.factors[at] * x[:, None]
    pairs = sum(v[i] @ v[j] for i in range(len(x)) for j in range(i))
    assert m.raw(at, x) == pytest.approx(m.bias + m.linear[at] @ x + pairs, rel=1e-3, abs=1e-4)


def test_op2(spark, place):
    got = Q["op2_token_output"](spark, place).collect()
    e, start = tokens.Encoder(tokens.default_path(), False), 0
    want = []
    for d, t in texts(spark, place):
        body = np.append(e.whole(t or ""), np.uint32(2)).astype("<u4").tobytes()
        want.append((d, len(body) // 4, zlib.crc32(body)))
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.n_tokens, r.ids_crc32)) for r in got)
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start) if r.doc_id is not None]
    assert ids == sorted(ids)


def test_control_byte_coding():
    rng = np.random.default_rng(3)
    for n in (0, 1, 3, 4, 5, 1000):
        ranks = (rng.integers(0, 2**32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
        assert (token_output.decode_ranks(*token_output.encode_ranks(ranks), n) == ranks).all()


def test_op3(spark, sf, odd):
    bench = [(r.item_id, b" " + b" ".join(decontaminate.norm_words(r.text)) + b" ") for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = {(d, i) for d, t in texts(spark, sf) for i, item in bench if item in b" " + b" ".join(decontaminate.norm_words(t)) + b" "}
    got = {(r.doc_id, r.item_id) for r in Q["op3_decontamination"](spark, sf).collect()}
    assert want <= got and len(got) <= len(want) + 1
    assert {(r.doc_id, r.item_id) for r in Q["op3_decontamination"](spark, odd).collect()} == {(4, 2)}


def test_the_latent_space_counts_every_passage_of_all_documents(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    pairs, n, total = decontaminate.count_terms(docs)
    want, seen, terms = np.zeros_like(pairs), np.zeros_like(n), decontaminate.Terms()
    texts = [r.text for r in docs.collect()]
    for text in texts:
        ids = terms.of(text)
        seen[np.unique(ids)] += 1
        for at in range(0, len(ids), 2 * decontaminate.HALF):
            for a in ids[at : at + 2 * decontaminate.HALF]:
                np.add.at(want[a], ids[at : at + 2 * decontaminate.HALF] % decontaminate.GROUPS, 1)
    assert total == sum(bool(decontaminate.norm_words(t)) for t in texts)
    assert (n == seen).all() and (pairs == want).all()


def test_items_of_any_length_are_found(spark):
    rng = random.Random(11)

    def some(n):
        return [f"w{int(900 * rng.random() ** 2)}" for _ in range(n)]

    items = [(i, " ".join(some(1 + i % 20) + [f"end{i}"])) for i in range(60)] + [(98, None), (99, " . ")]
    docs = []
    for i, text in items[:60]:
        words = some(rng.randrange(30, 300))
        at = rng.randrange(len(words))
        docs.append((i, " ".join([*words[:at], text, *words[at:]])))
    docs.append((100, " ".join(some(5000))))
    docs, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for sample in (decontaminate.SAMPLE, 5):  # what the basis is fitted on loses nothing
        got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench, sample).collect()}
        assert {(i, i) for i in range(60)} <= got
        assert not {(d, i) for d, i in got if d != i and len(items[i][1].split()) < decontaminate.LEAST}


def test_recall_of_planted_items(spark):
    """Items planted verbatim, and with a tenth and a fifth of their words replaced."""
    rng = random.Random(15)
    word = lambda: f"w{int(3000 * rng.random() ** 2)}"
    items = [(i, " ".join(word() for _ in range(rng.randrange(24, 60)))) for i in range(40)]
    docs, planted = [], {}
    for n, (share, least) in enumerate(((0.0, 1.0), (0.1, 0.95), (0.2, 0.9))):
        for i, text in items:
            w = [x if rng.random() >= share else f"new{rng.randrange(10**6)}" for x in text.split()]
            around = [word() for _ in range(rng.randrange(50, 400))]
            at = rng.randrange(len(around))
            docs.append((1000 * n + i, " ".join([*around[:at], *w, *around[at:]])))
            planted[1000 * n + i] = i
    docs += [(9000 + i, " ".join(word() for _ in range(300))) for i in range(200)]
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {d for d, _ in got} <= set(planted) and all(planted[d] == i for d, i in got)
    for n, least in enumerate((1.0, 0.95, 0.9)):
        assert sum(d // 1000 == n for d, _ in got) >= least * len(items)


def test_rarest_words_miss_no_place():
    """The searcher against every place of every text, without a gate."""
    rng, terms = random.Random(12), decontaminate.Terms()
    items = [(i, " ".join(f"w{int(60 * rng.random() ** 2)}" for _ in range(rng.randrange(8, 40))), None) for i in range(20)]
    weight = np.random.default_rng(0).random(decontaminate.TERMS).astype(np.float32) + 1
    basis = np.random.default_rng(1).standard_normal((decontaminate.TERMS, 8)).astype(np.float32)
    searcher = decontaminate.Searcher(items, weight, basis, 10.0)
    for _ in range(40):
        words = [w for i in rng.sample(range(20), 2) for w in [f"w{int(90 * rng.random() ** 2)}" for _ in range(rng.randrange(60))] + [w for w in items[i][1].split() if rng.random() < 0.8]]
        text, want = " ".join(words), set()
        found, halves = decontaminate.norm_words(text), -(-len(terms.of(text)) // decontaminate.HALF)
        for x in searcher.items:
            n = len(x.words)
            for p in range(max(1, halves - 1)):
                if x.leak(found[max(0, p * decontaminate.HALF - n) : (p + 2) * decontaminate.HALF + n])[2]:
                    want.add(x.id)
        assert {leak[0] for leak in searcher.leaks(text)} == want


def test_common_subsequence():
    rng = random.Random(5)
    for _ in range(200):
        a, b = ([bytes([rng.randrange(97, 101)]) for _ in range(rng.randrange(1, 70))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            last, row = row, [0]
            for j, y in enumerate(b):
                row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
        assert decontaminate.common_subsequence(decontaminate.Item._masks(a), len(a), b) == row[-1]


def test_op4(spark, place):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    want = []
    for d, t in texts(spark, place):
        t = t or ""
        w = word.findall(t)
        windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        again = {i + k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(8)}
        lines = [x for x in t.split("\n") if word.search(x)]
        failed = len(w) < 20 or 100 * len(again) > 30 * len(w)
        want.append(repr((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again), failed)))
    got = Q["op4_quality_rules"](spark, place).collect()
    assert sorted(want) == sorted(repr(tuple(r)[:7]) for r in got)
    assert not any(r.kept and r.base_failed for r in got)


def test_languages_without_a_reference_are_not_judged_by_others(spark):
    rng, english = random.Random(6), quality_rules.COMMON["en"].split()
    rows = [(i, " ".join(rng.choices(english, k=400)), "en") for i in range(20)]
    rows += [(100 + i, " ".join(f"sana{rng.randrange(10_000)}" for _ in range(400)), lang) for i, lang in enumerate(["fi", "fi", "et", None, "en"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r.doc_id for r in quality_rules.score_rules(docs).collect() if r.kept}
    assert kept == {*range(20), 100, 101, 102, 103}
    assert {r.doc_id for r in quality_rules.filter_rules(docs).collect()} == kept


def test_kept_by_brute_force(spark, sf):
    """The verdicts from references and distances worked out with plain counters."""
    rows = [(r.doc_id, r.text or "", r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    word = re.compile(r"[^\x20\x09-\x0D]+")
    common = {w for ws in quality_rules.COMMON.values() for w in ws.split()}

    def kind(c):
        tests = (("lower", c.islower()), ("upper", c.isupper()), ("digit", c.isdigit()), ("space", c.isspace()), ("stop", c in ".,;:"), ("mark", c in "!?'\"()-¿¡«»"), ("symbol", c in "#*$%&|<>~^_=+/\\@{}[]`"))
        return next((n for n, hit in tests if hit), "other") if ord(c) < 0x250 else "other"

    def share(counts):
        total = sum(counts.values())
        return {k: v / total for k, v in counts.items()}

    def apart(p, q):
        m = {k: (p.get(k, 0) + q.get(k, 0)) / 2 for k in {*p, *q}}
        part = lambda x: sum(v * np.log2(v / m[k]) for k, v in x.items() if v > 0)
        return max(0.0, (part(p) + part(q)) / 2) ** 0.5

    held, sums, counted = {}, defaultdict(lambda: (Counter(), Counter())), Counter()
    for d, t, lang in rows:
        w = word.findall(t)
        failed = quality_rules.base_failed(len(w), quality_rules.repeated_words([x.encode() for x in w]))
        classes = Counter(map(kind, t))
        words = Counter((b if (b := x.strip(".,;:!?\"'()")) in common else "") for x in w)
        held[d] = len(w), failed, classes, words, lang
        if len(w) >= 50 and not failed:
            counted[lang] += 1
            for total, own in zip(sums[lang], (classes, words)):
                for k, v in share(own).items():
                    total[k] += v
    refs = [tuple(map(share, sums[lang])) for lang in sums if counted[lang] >= quality_rules.LEAST_DOCS]
    want = {}
    for d, (n, failed, classes, words, lang) in held.items():
        noise, kept = max(n, 1) ** -0.5, not failed
        if kept and counted[lang] >= quality_rules.LEAST_DOCS:
            if sum(classes.values()) >= quality_rules.LEAST_CHARS:
                kept = min(apart(share(classes), r[0]) for r in refs) <= quality_rules.CLASS_LIMIT[0] + quality_rules.CLASS_LIMIT[1] * noise
            if kept and n >= quality_rules.LEAST_WORDS:
                kept = min(apart(share(words), r[1]) for r in refs) <= quality_rules.WORD_LIMIT[0] + quality_rules.WORD_LIMIT[1] * noise
        want[d] = kept
    got = {r.doc_id: r.kept for r in Q["op4_quality_rules"](spark, sf).collect()}
    assert got == want and 0 < sum(got.values()) < len(got)


def test_divergence():
    assert quality_rules.distance(np.array([1.0, 0]), np.array([0, 1.0])) == pytest.approx(1)
    assert quality_rules.distance(np.array([3.0, 1]), np.array([3.0, 1])) == 0


def test_op5(spark, place):
    got = Q["op5_packing"](spark, place).collect()
    e, windows = tokens.Encoder(tokens.default_path(), False), defaultdict(list)
    left = Counter()
    for d, t in texts(spark, place):
        body = np.append(e.whole(t or ""), np.uint32(0)).astype("<u4")
        left[d, len(body)] += len(body)
    for r in got:
        windows[r.sequence_id].append(r)
        left[r.doc_id, r.doc_tokens] -= r.length
    assert not any(left.values())
    for pieces in windows.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024


def test_documents_are_cut_only_for_padding():
    rng = random.Random(16)
    for most, cut_share in ((200, 0.0), (1023, 0.4)):
        sizes = [rng.randrange(1, most + 1) for _ in range(400)]
        found, got = packing.windows(sizes, 1024), defaultdict(list)
        for w in found:
            assert 0 < sum(n for _, _, n in w) <= 1024
            for i, begin, n in w:
                got[i].append((begin, n))
        for i, size in enumerate(sizes):  # every id in just one piece
            at = 0
            for begin, n in sorted(got[i]):
                assert begin == at and n > 0
                at += n
            assert at == size
        assert len(found) * 1024 <= 1.02 * sum(sizes) + 1024
        assert sum(len(x) > 1 for x in got.values()) <= cut_share * len(sizes)


def test_differencing_is_near_equal():
    rng = random.Random(6)
    sizes = [rng.randrange(1, 257) for _ in range(600)]
    sums = [sum(sizes[i] for i in s) for s in packing.fit(sizes, 1024)]
    assert max(sums) <= 1024 and max(sums) - min(sums) <= 32 and sum(sums) == sum(sizes)


def brute_components(rows, width):
    sets = [(d, near_dup.shingle_set(t, width)) for d, t in rows]
    label = {d: d for d, _ in sets if d is not None}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and a is not None and b is not None and 100 * len(x & y) >= 80 * len(x | y):
                low, high = sorted((root(a), root(b)))
                label[high] = low
    return sorted(repr((d, len(x), None if d is None else root(d), d is None or root(d) == d)) for d, x in sets)


@pytest.mark.parametrize("group", [1024, 7])
def test_op6(spark, odd, group, monkeypatch):
    monkeypatch.setattr(near_dup, "GROUP", group)
    got = sorted(repr(tuple(r)) for r in Q["op6_near_dedup"](spark, odd).collect())
    assert got == brute_components(texts(spark, odd), 2)


def test_near_copies_in_a_crowd(spark, monkeypatch):
    """Copies whose similarity lies around the limit, in buckets of several components."""
    rng = random.Random(9)
    base, rows = [f"w{i}" for i in range(150)], []
    for i in range(160):
        words = list(base)
        for _ in range(rng.randrange(4, 18)):
            words[rng.randrange(150)] = f"x{rng.randrange(300)}"
        rows.append((i, " ".join(words)))
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(repr(tuple(r)) for r in got) == brute_components(rows, 2)


@pytest.mark.parametrize("few", [0, 128])
def test_links_of_many_sets(few, monkeypatch):
    """By rarest differences or multiplied: the same groups as by brute force, and only links between them."""
    monkeypatch.setattr(near_dup, "FEW", few)
    rng = random.Random(4)
    for trial in range(150):
        monkeypatch.setattr(near_dup, "MET", rng.choice([1, 5, 1 << 20]))
        n, percent = rng.randrange(4, 40), rng.choice([80, 80, 50, 90, 100])
        bases = [[rng.randrange(10**6) for _ in range(rng.choice([3, 10, 40]))] for _ in range(rng.choice([1, 1, 3]))]
        sets = []
        for _ in range(n):
            words = list(rng.choice(bases))
            for _ in range(rng.randrange(max(2, len(words) // 4))):
                words[rng.randrange(len(words))] = rng.randrange(rng.choice([5, 10**6]))
            sets.append(np.unique(np.array(words[: rng.choice([len(words), max(1, len(words) * 9 // 10)])], np.uint64)))
        label, held = np.arange(n), [set(x.tolist()) for x in sets]
        side = np.full(n, -1) if trial % 2 else np.array([rng.randrange(2) for _ in range(n)])

        def groups(links):
            above = list(range(n))
            for a, b in links:
                above = [min(above[a], above[b]) if x in (above[a], above[b]) else x for x in above]
            return above

        want = [(a, b) for a in range(n) for b in range(a) if (side[a] < 0 or side[a] != side[b]) and 100 * len(held[a] & held[b]) >= percent * len(held[a] | held[b])]
        got = list(near_dup.linked(sets, label, side, percent))
        assert all(100 * len(held[a] & held[b]) >= percent * len(held[a] | held[b]) for a, b in got) and len(got) < n
        assert groups(got) == groups(got + want) and (side[0] >= 0 or groups(got) == groups(want))


def test_a_crowd_of_links_gives_few_pairs(spark, tmp_path):
    """200 texts that are all linked with each other: their pairs are 19,900."""
    rows = [(i, i, " ".join([f"w{k}" for k in range(60)] + [f"x{i}"])) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, label long, text string")
    near_dup.S.small_batches(spark)
    linker = near_dup.Linker(f"file://{tmp_path}", 2, 80)
    pairs = near_dup.in_blocks(docs.select(F.col("doc_id").alias("node"), "label"), docs.select("doc_id", "text"), linker, near_dup.HALF, near_dup.ROWS)
    assert pairs.count() < 200 * near_dup.HALF
    linker.confirm(pairs, docs.select("doc_id", "text"))
    assert {(r.node, r.label) for r in linker.labels.collect()} == {(i, 0) for i in range(1, 200)}


def test_op7(spark, odd):
    by = defaultdict(list)
    for r in spark.read.parquet(f"{odd}/conversations.parquet").collect():
        by[r.conv_id].append((r.turn is not None, r.turn or 0, r.role is not None, r.role or "", r.text is not None, r.text or ""))
    by[-7] = [(True, k, True, role, True, "\\### Assistant: </turn> ok") for k, role in enumerate(("user", "assistant"))]
    want = []
    for c, turns in by.items():
        said = [(x[3], x[5]) for x in sorted(turns)]
        loss = "".join(t for r, t in said if r == "assistant")
        want.append(repr((c, len(said), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(chat.default_template(said)))))
    assert sorted(want) == sorted(repr(tuple(r)) for r in Q["op7_chat_formatting"](spark, odd).collect())


def test_long_conversations_are_rendered_whole():
    def numbered(turns):
        return "".join(f"{i}. {r}: {t}\n" for i, (r, t) in enumerate(turns, 1))

    def forgets(turns):  # from 35 turns on, the tenth is dropped
        return numbered([x for i, x in enumerate(turns) if i != 9 or len(turns) < 35])

    turns = [("user", f"said {i}") for i in range(40)]
    state = chat.Incremental(numbered)
    assert "".join(state.add(*t)[0] for t in turns) == numbered(turns)
    state = chat.Incremental(forgets)
    assert [i for i, t in enumerate(turns) if state.add(*t)[3]] == [34]
    state = chat.Incremental(chat.default_template)
    assert "".join(state.add(*t)[0] for t in turns) == chat.default_template(turns) and len(state.turns) < 40


def test_rewritten_history_is_detected():
    def rewriting(turns):  # drops all but the last thought
        return "".join(f"[{r}]{t if r != 'think' or k == len(turns) - 1 else ''}|" for k, (r, t) in enumerate(turns))

    state = chat.Incremental(rewriting)
    assert [state.add(r, t)[3] for r, t in (("user", "a"), ("think", "b"), ("user", "c"))] == [False, False, True]


def test_a_rewriting_template_gives_its_own_output(spark):
    def thinking(turns):  # only the last thought is shown
        return "<s>" + "".join(f"[{r}]{t if r != 'think' or k == len(turns) - 1 else ''}|" for k, (r, t) in enumerate(turns))

    said = {1: [("user", "a"), ("think", "bb"), ("user", "c"), ("think", "dd")], 2: [("user", "x"), ("user", "y")], 3: [("user", f"n{i}") if i % 2 else ("think", f"n{i}") for i in range(80)]}
    rows = [(c, i, r, t) for c, turns in said.items() for i, (r, t) in enumerate(turns)]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), thinking).collect()
    assert sorted(r.conv_id for r in got) == [1, 2, 3]
    for r in got:
        turns = said[r.conv_id]
        assert r.formatted == thinking(turns) and len(r.spans) == len(turns)
        assert any(s.rewrites for s in r.spans) == (r.conv_id != 2)
        for i, (s, (role, text)) in enumerate(zip(r.spans, turns)):
            shown = text if role != "think" or i == len(turns) - 1 else ""
            assert r.formatted[s.text_begin : s.text_end] == shown and s.begin <= s.text_begin <= s.text_end <= s.end


def test_op8(spark, odd):
    rows = spark.read.parquet(f"{odd}/pages.parquet").collect()
    keeper = defaultdict(list)
    for r in rows:
        keeper[(r.html or "")].append(r.page_id)
    want = []
    for r in rows:
        body = (r.html or "").encode()
        top = max((p for p in keeper[r.html or ""] if p is not None), default=None)
        revisit = r.page_id != top
        want.append(repr((r.page_id, len(body), warc.payload_digest(body), "revisit" if revisit else "response", top if revisit else None)))
    assert sorted(want) == sorted(repr(tuple(r)) for r in Q["op8_warc"](spark, odd).collect())


def test_index_lookup(spark, sf, tmp_path):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    folder = f"file://{tmp_path}"
    directory = warc.Directory.load(warc.write_index(warc.write_archives(pages, folder), folder, block=7))
    rows = pages.collect()
    for r in rows[::9]:
        found = {c[1] for c in directory.lookup(r.url)}
        assert found == {x.page_id for x in rows if warc.url_key(x.url) == warc.url_key(r.url)}
    assert directory.lookup("http://nowhere.invalid/") == [] and directory.lookup("http://zz.zz/") == []
    assert warc.url_key("https://www.Ex.com:443/A?b=C") == "com,ex)/a?b=c"


def test_a_url_of_many_blocks_and_files(spark, tmp_path):
    rows = [(i, "http://hot.example/" if i % 3 else f"http://e{i % 40}.example/{i}", f"<p>{i}") for i in range(600)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    folder = f"file://{tmp_path}"
    index = warc.write_index(warc.write_archives(pages, folder), folder, block=8)
    assert index.count() > 1
    directory = warc.Directory.load(index)
    assert len(directory.lookup("http://hot.example/")) == 400
    for i, url, _ in rows[::30]:
        assert {c[1] for c in directory.lookup(url)} == {p for p, u, _ in rows if u == url}
    some = pages.filter("page_id % 7 = 0")
    want = {u for i, u, _ in rows if i % 7 == 0}
    got = warc.read_archives(warc.look_up(some, index)).collect()
    assert sorted(r.page_id for r in got) == [i for i, u, _ in rows if u in want]
    assert all(r.payload == rows[r.page_id][2].encode() for r in got)


def test_a_second_attempt_leaves_the_first_ones_files(spark, tmp_path):
    """Archives of two runs in one folder: each run's captures name its own files."""
    pages = spark.createDataFrame([(i, f"http://a.b/{i}", f"<p>{i}") for i in range(50)], "page_id long, url string, html string")
    folder = f"file://{tmp_path}"
    first = [tuple(r) for r in warc.write_archives(pages, folder).collect()]
    second = [tuple(r) for r in warc.write_archives(pages.filter("page_id % 2 = 0"), folder).collect()]
    assert not {r[2] for r in first} & {r[2] for r in second}
    for _, page_id, file, offset, length, _ in first:
        assert warc.parse(warc.read_range(file, offset, length))[2] == f"<p>{page_id}".encode()


def test_op9(spark, odd):
    begin, rest = map(set, token_counts.vocabulary(tokens.default_path()))

    def greedy(w):
        at = n = 0
        while at < len(w):
            end = next((j for j in range(min(len(w), at + 200), at, -1) if w[at:j] in (rest if at else begin)), None)
            if end is None:
                return 0
            at, n = end, n + 1
        return n

    want = []
    for d, t in texts(spark, odd):
        counts = [greedy(w) for w in (t or "").encode().split()]
        want.append(repr((d, len(counts), sum(c or 1 for c in counts), counts.count(0))))
    assert sorted(want) == sorted(repr(tuple(r)) for r in Q["op9_token_counts"](spark, odd).collect())


def test_automaton_by_chance():
    rng = random.Random(7)
    word = lambda n: bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, n)))
    for _ in range(300):
        begin, rest = ({word(6) for _ in range(rng.randrange(1, 9))} for _ in range(2))
        a = token_counts.Automaton(begin, rest)
        for _ in range(20):
            w, at, n = word(15), 0, 0
            want = None
            while at < len(w) and want is None:
                end = next((j for j in range(len(w), at, -1) if w[at:j] in (rest if at else begin)), None)
                at, n, want = (end, n + 1, None) if end else (at, n, 0)
            assert a.count(w) == (n if want is None else 0)


def test_op10(spark, place):
    rows, got = texts(spark, place), Q["op10_sharding"](spark, place).collect()
    want = sorted(repr((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))) for d, t in rows)
    assert want == sorted(repr((r.doc_id, r.size, r.text_crc32)) for r in got)
    slots, sizes = defaultdict(list), Counter()
    for r in got:
        assert 0 <= r.shard < 16 and r.law == "bytes" and r.grown_shard is None
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) <= sum(sizes.values()) / 16 + max(r.size for r in got)


@pytest.mark.parametrize("copies", [[24, 40], [3, 700], [1, 900]])
def test_groups_keep_the_quota(spark, copies):
    groups, each = copies
    rng = random.Random(groups)
    rows = [(g * each + i, f"group {g} " + "x" * 500) for g in range(groups) for i in range(each)]
    rows += [(10_000 + i, f"single {i} " + "y" * rng.randrange(1000)) for i in range(groups * each // 3)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.key for r in got) == [d for d, _ in rows]
    sizes, where, slots = Counter(), defaultdict(set), defaultdict(list)
    for r in got:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
        if r.key < 10_000:
            where[r.key // each].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) <= sum(sizes.values()) / 16 + max(r.size for r in got)
    if groups == 24:  # groups of half a quota: most of them stay whole
        assert sum(len(w) == 1 for w in where.values()) >= 12


def test_propagation_gathers_groups(spark):
    """Rounds cut fewer and fewer edges, counted here from the shards, and sizes stay even."""
    rng = random.Random(21)
    rows = [(i, f"group {rng.randrange(400)} " + "x" * 300) for i in range(3000)] + [(10_000 + i, f"single {i} " + "y" * 300) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    cuts = {}
    for rounds in (0, 1, 8):
        report, by, sizes = [], defaultdict(Counter), Counter()
        for r in sharding.shard_documents(docs, rounds=rounds, report=report).collect():
            by[rows[r.key][1] if r.key < 10_000 else r.key][r.shard] += 1
            sizes[r.shard] += r.size
        cuts[rounds] = sum(sum(c.values()) - max(c.values()) for c in by.values())
        assert max(sizes.values()) <= sum(sizes.values()) / 16 + 400
        moved = [bytes_ for _, bytes_ in report]
        assert [c for c, _ in report] == sorted((c for c, _ in report), reverse=True) and moved[-1] == 0
        assert (len(report) > 1 and moved[0] > 0) == (rounds > 0)
        if not rounds:
            assert report[0][0] > 2000  # by their own hash, documents lie apart
    assert cuts[0] > 2000 and cuts[1] < cuts[0] / 4 and cuts[8] <= cuts[1]


def test_a_hot_group_is_joined_in_slices(spark, monkeypatch):
    monkeypatch.setattr(sharding, "HOT", 4)
    rows = [(i, "hot" if i % 3 else f"text {i // 9}") for i in range(900)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.key for r in got) == list(range(900))
    assert {r.key: r.crc for r in got} == {i: zlib.crc32(t.encode()) for i, t in rows}


def test_flow_keeps_the_quota():
    rng = np.random.default_rng(8)
    for _ in range(50):
        wanted = rng.random((6, 6)) * 10 * (1 - np.eye(6))
        load = wanted.sum(1) + rng.random(6) * 5
        share = sharding.allowed_flow(wanted, load, load.mean() * 1.1)
        moved = wanted * share
        after = load - moved.sum(1) + moved.sum(0)
        assert (after <= np.maximum(load, load.mean() * 1.1) + 1e-6).all()


def test_columns_stay(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, odd)
        assert out.columns == docs.columns and out.count() <= docs.count()
    assert docs.filter(F.col("kept") == "clash").count() == docs.count()


def test_leaks_go_by_their_own_text(spark, odd):
    """Null and shared ids, and columns with clashing names: a leak goes, a clean row stays."""
    item = " ".join(LONG.split()[500:540])
    rows = [(None, f"{GOOD} {item}", "a"), (None, GOOD, "b"), (7, item, "c"), (7, GOOD, "d"), (8, None, "e"), (9, "", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _leaked string")
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    found = decontaminate.drop_leaks(docs, benchmark)
    assert found.columns == docs.columns
    assert sorted(r._leaked for r in found.collect()) == ["b", "d", "e", "f"]


def test_keep_one_bears_clashing_names(spark):
    docs = spark.createDataFrame([("x", 2, GOOD, 1), ("y", 1, GOOD, 2), ("z", 3, "one two three four five six", 3), ("n", None, GOOD, 4)], "_gone string, doc_id long, text string, _row int")
    found = near_dup.keep_one(docs)
    assert found.columns == docs.columns
    assert sorted(r._gone for r in found.collect()) == ["y", "z"]  # a null id is a row like any, the last to stay


def test_keep_one_judges_rows(spark):
    other = " ".join(f"other{i}" for i in range(40))
    docs = spark.createDataFrame([(1, GOOD), (1, GOOD), (2, GOOD), (2, other), (None, GOOD), (None, other), (None, "six words that are never repeated"), (5, None), (6, "")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in near_dup.keep_one(docs).collect()), key=str)
    assert got == sorted([(1, GOOD), (2, other), (None, "six words that are never repeated"), (5, None), (6, "")], key=str)


def test_rows_of_one_id_are_one_document(spark):
    """Id 5 has two texts; 3 is a copy of the one, 9 of the other."""
    other = " ".join(f"other{i}" for i in range(40))
    rows = [(5, GOOD), (5, other), (3, GOOD), (9, other), (8, "alone in the world")]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(5, 3), (3, 3), (9, 3), (8, 8)}


def test_pipeline_stages_leave_others_scratch_alone(spark, sf):
    made = Q["op2_token_output"](spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = corpus_pipeline.near_duplicates(spark, docs, sf).count()
    assert made.count() == docs.count() >= first > 0
