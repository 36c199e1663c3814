"""Each operator against a brute-force version on small tables that hold nulls, empty and long texts, repeated rows,
ties and clashing columns; and on empty tables."""

import base64
import collections
import hashlib
import math
import re
import zlib

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import bpe, decontaminate, language, lines, lm, near, token_counts, topk, toxicity, urls

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, spans string, component string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
A = " ".join(f"alpha{i} beta{i % 7}" for i in range(60))
B = " ".join(f"gamma{i}" for i in range(120))
LONG = " ".join(f"w{i * i % 7919}" for i in range(9000))


def rows():
    near_a = A.replace("alpha30 ", "changed ")
    texts = [
        A, A, near_a, B, None, "", "   \n\n", "short", "short", "Word word", f"{A}\n{B}\nend of one", f"other start\n{B}\nother end", LONG, f"{LONG}\nand more",
        "x" * 3000, "émigré ÇA va İ ﬁn — 日本語 123", "<|endoftext|> it'll we're 's", f"the start {' '.join(B.split()[:10])} the end", "\t tabs\x0band\x1cmore blanks  two", "a b a b b a b b b a a b",
    ]
    out = [(i, t, "en", "s", None, "clash", "clash", "clash") for i, t in enumerate(texts)]
    return [*out, out[3], (None, A, None, None, 1, "n", "s", "c"), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def ranks():
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}


def test_bpe_ids_and_round_trip(docs, none):
    path = P.path("byte_bpe_50k.tiktoken")
    known = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks(), special_tokens={})
    decoded = bpe.decode(bpe.encode(docs, path, P.PATTERN), path)
    want = [(r[0], known.encode_ordinary(r[1] or ""), (r[1] or "").encode()) for r in rows()]
    assert sorted(((r.doc_id, r.ids, bytes(r.decoded)) for r in decoded.collect()), key=repr) == sorted(want, key=repr)
    assert by_rows(bpe.round_trip(docs, path, P.PATTERN), "doc_id", "ids", "decoded") == by_rows(decoded, "doc_id", "ids", "decoded")
    assert bpe.encode(none, path, P.PATTERN).count() == 0


def test_token_counts_and_prefixes(docs, none):
    path = P.path("word_bpe_49k.json")
    known = Tokenizer.from_file(path)
    count = lambda t: len(known.encode(t, add_special_tokens=False).ids)
    got = by_rows(token_counts.count_tokens(docs, path), "doc_id", "n_bytes", "n_tokens")
    assert got == sorted(((r[0], len((r[1] or "").encode()), count(r[1] or "")) for r in rows()), key=repr)
    small = docs.where("length(text) between 1 and 60 and doc_id is not null and not text like '<%'").dropDuplicates(["doc_id"])
    for r in token_counts.prefix_table(small, path).join(small, "doc_id").collect():
        plain = known.normalizer.normalize_str(r.text)
        assert r.prefix_tokens == [count(plain[:i]) for i in range(len(plain) + 1)]
    table = token_counts.prefix_table(small, path).select("doc_id", token_counts.tokens_at("prefix_tokens", 4).alias("n"), token_counts.longest_within("prefix_tokens", 1).alias("c"))
    assert {r.doc_id: (r.n, r.c) for r in table.collect()}[9] == (1, 5)  # "word word"
    assert token_counts.count_tokens(none, path).count() == 0


def test_decontamination(spark, docs, none):
    items = [(7, " ".join(B.split()[:14])), (11, "WORD word"), (3, None), (4, " .,; "), (5, "émigré ça")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    windows = collections.defaultdict(set)
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 9)) if w else ():
            windows[tuple(w[i : i + 10])].add(str(item))
    want = []
    for r in rows():
        w, hit, found = words(r[1]), set(), set()
        for window, owners in windows.items():
            for i in range(len(w) - len(window) + 1):
                if tuple(w[i : i + len(window)]) == window:
                    hit |= set(range(i, i + len(window)))
                    found |= owners
        want.append((r[0], len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    indexed = decontaminate.index(docs).cache()
    for blocks in (decontaminate.blocks(bench), decontaminate.blocks(bench, block_bytes=20)):
        assert by_rows(decontaminate.digest(decontaminate.search(indexed, blocks)), *columns) == sorted(want, key=repr)
    clean = decontaminate.without_hits(docs, decontaminate.blocks(bench, block_bytes=20))
    assert clean.columns == docs.columns and clean.count() == sum(not w[-1] for w in want)
    assert by_rows(clean, "doc_id", "text") == sorted(((r[0], r[1]) for r, w in zip(rows(), want, strict=True) if not w[-1]), key=repr)
    assert decontaminate.without_hits(none, decontaminate.blocks(bench)).count() == 0 and decontaminate.without_hits(docs, decontaminate.blocks(bench.limit(0))).count() == docs.count()
    assert decontaminate.search(decontaminate.index(none), decontaminate.blocks(bench)).count() == 0
    assert not any(r.contaminated for r in decontaminate.digest(decontaminate.search(indexed, decontaminate.blocks(bench.limit(0)))).collect())


def test_proximity(spark, docs, none):
    items = [(1, "the start gamma2"), (2, "gamma5 gamma9"), (3, "b a b"), (4, "word"), (5, ""), (6, "missing word"), (7, "alpha3 beta4")]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    texts = [(r[0], words(r[1])) for r in rows()]
    every, want = collections.Counter(w for _, t in texts for w in t), []
    for item, phrase in items:
        p = words(phrase)
        anchor = min(range(len(p)), key=lambda k: every[p[k]], default=0)
        for d, t in texts:
            for at in [i for i, w in enumerate(t) if p and w == p[anchor]]:
                first, last = at, at
                for w in p[:anchor][::-1]:
                    first = max((i for i in range(first) if t[i] == w), default=None) if first is not None else None
                for w in p[anchor + 1 :]:
                    last = min((i for i in range(last + 1, len(t)) if t[i] == w), default=None) if last is not None else None
                if None not in (first, last) and last - first < len(p) + 3:
                    want.append((str(item), d, first, last + 1))
    got = decontaminate.search_near(decontaminate.index(docs), spark.createDataFrame(items, "item_id long, text string"), 3)
    assert by_rows(got, "item_id", "doc_id", "start", "end") == sorted(want, key=repr) and len({w[0] for w in want}) > 4
    assert decontaminate.search_near(decontaminate.index(none), spark.createDataFrame(items, "item_id long, text string"), 3).count() == 0


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset([tuple(w)] if 0 < len(w) < width else [tuple(w[i : i + width]) for i in range(len(w) - width + 1)])


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80)])
def test_near_duplicates(spark, docs, none, width, percent):
    base = [f"t{i}" for i in range(150)]
    more = [(100 + k, " ".join(w if i % 50 != k else f"new{k}" for i, w in enumerate(base)), "en", "s", 1, "", "", "") for k in range(12)]
    every = docs.unionByName(spark.createDataFrame(more, SCHEMA))
    data = [(r[0], shingles(r[1], width)) for r in [*rows(), *more]]
    parent = {d: d for d, _ in data if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d, s in data:
        for e, t in data:
            if None not in (d, e) and d < e and s and t and 100 * len(s & t) >= percent * len(s | t):
                a, b = sorted((find(d), find(e)))
                parent[b] = a
    want = sorted(((d, len(s), None if d is None else find(d)) for d, s in data), key=repr)
    assert by_rows(near.near_duplicates(every, width, percent), "doc_id", "n_shingles", "component_id") == want
    kept = near.one_of_each(every, width, percent)
    assert kept.columns == docs.columns
    named = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert named == sorted({d for d, s in data if d is not None and (not s or find(d) == d)})
    assert near.near_duplicates(none).count() == 0


def test_exact_pass_lists_no_pair_that_is_far_apart(spark):
    """A group of large sets that share half of their shingles, and two that are similar enough; the bucket counts alone let
    every pair pass."""
    import numpy as np

    rng = np.random.default_rng(5)
    common = [f"c{i}" for i in range(3000)]
    texts = [" ".join([*common, *(f"own{d}x{i}" for i in range(1200))]) for d in range(12)]
    own = texts[0].split()
    for at in rng.choice(len(own), 40, replace=False):
        own[at] = f"changed{at}"
    texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = near.set_table(docs, 3)
    groups = spark.createDataFrame([(s, i, i, len(texts)) for s in (1, 2) for i in range(len(texts))], "sig long, id long, component long, n long")
    assert [(r.a, r.b) for r in near._block_pairs(groups, sets, 80).collect()] == [(0, 12)]


def test_odd_sketches_never_exceed_the_difference():
    import numpy as np

    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (0, 1, 5, 60, 300, 301, 1000, 40_000)]
    sets += [np.union1d(s[: len(s) * 9 // 10], rng.integers(0, 2**63, 3).astype(np.uint64)) for s in sets]
    odd = near.OddSketches([near.odd_sketch(s) for s in sets])
    for x, p in enumerate(sets):
        true = np.array([len(np.setxor1d(p, q)) for q in sets])
        apart = odd.apart(x, np.arange(len(sets)))
        assert (apart <= true).all() and apart[x] == 0
    large = np.array([6, 14])
    assert odd.apart(6, large)[1] > 0.9 * len(np.setxor1d(sets[6], sets[14]))


def test_signatures_lose_no_similar_pair():
    import random

    rng, lost, seen = random.Random(5), 0, 0
    for percent, width in ((90, 3), (80, 5)):
        bands = near.Bands(percent, 2000)
        for _ in range(400):
            a = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice((rng.randint(1, 40), rng.randint(40, 400))))]
            b = list(a)
            for _ in range(rng.randint(0, max(1, len(a) // 25))):
                b[rng.randrange(len(b))] = f"x{rng.randrange(10**6)}"
            s, t = shingles(" ".join(a), width), shingles(" ".join(b), width)
            if s != t and 100 * len(s & t) >= percent * len(s | t):
                index, sign = near.signatures(*near.shingle_sets([" ".join(a), " ".join(b)], width), bands)
                seen, lost = seen + 1, lost + (not set(sign[index == 0]) & set(sign[index == 1]))
    assert seen > 50 and lost == 0


def test_signatures_of_large_sets_at_the_threshold():
    """Where chance takes the place of spare parts: pairs with no difference to spare."""
    import numpy as np

    rng, bands = np.random.default_rng(3), {p: near.Bands(p, 4000) for p in (80, 90)}
    for percent in (80, 90):
        for n in (200, 400, 1000):
            for _ in range(60):
                shared = next(s for s in range(n) if 100 * s >= percent * (2 * n - s))
                u = rng.integers(0, 2**63, 2 * n - shared, dtype=np.uint64)
                a, b = np.sort(u[:n]), np.sort(np.concatenate((u[:shared], u[n:])))
                index, sign = near.signatures(np.concatenate((a, b)), np.array([0, n, 2 * n]), bands[percent])
                assert set(sign[index == 0]) & set(sign[index == 1])


def brute_lines(data, least):
    ordered = sorted({(2**63 - 1 if d is None else d, t) for d, t in data if t is not None}, key=lambda x: x[0])
    first, seqs = {}, []
    for k, (d, t) in enumerate(ordered):
        seq = [(p, line) for p, line in enumerate(t.split("\n")) if re.search(r"\S", line)]
        seqs.append(seq)
        for i in range(len(seq)):
            for j in range(i, min(len(seq), i + least)):
                first.setdefault(tuple(line for _, line in seq[i : j + 1]), (k, i))
    out = {}
    for k, (d, t) in enumerate(ordered):
        seq, gone = seqs[k], set()
        for i in range(len(seq)):
            run = 0
            for j in range(i, min(len(seq), i + least)):
                if first[tuple(line for _, line in seq[i : j + 1])] == (k, i):
                    break
                run = j - i + 1
            if sum(len(line.split()) for _, line in seq[i : i + run]) >= least:
                gone |= set(range(seq[i][0], seq[i + run - 1][0] + 1))
        out[d, t] = "\n".join(line for p, line in enumerate(t.split("\n")) if p not in gone)
    return out


def test_line_dedup(spark, docs, none, monkeypatch):
    monkeypatch.setattr(lines, "RANGE", 9)  # many ranges, so that runs reach across them
    extra = [(50 + k, "\n".join([f"own {k}", *[f"line {i} of a run with words" for i in range(k, k + 9)], "", f"end {k}", "line 3 of a run with words"])) for k in range(6)]
    extra += [(70, "rep one two three\n" * 30), (71, "rep one two three\n" * 12 + "x")]
    data = [*[(r[0], r[1]) for r in rows()], *extra]
    every = docs.select("doc_id", "text", "source").unionByName(spark.createDataFrame([(*x, "s") for x in extra], "doc_id long, text string, source string"))
    for least in (20, 50):
        want = brute_lines(data, least)
        got = lines.dedup_lines(every, least)
        assert by_rows(got, "doc_id", "text") == sorted(((d, t if t is None else want[2**63 - 1 if d is None else d, t]) for d, t in data), key=repr)
    assert lines.without_copies(docs).columns == docs.columns
    assert lines.dedup_lines(none).count() == 0


def test_language(spark, docs, none):
    known = [(i, t * 6, lang) for i, (t, lang) in enumerate([("the house and the garden with that thing ", "en"), ("der und nicht ein über schön wasser ", "de"), ("они быть который слово мир ", "ru")] * 6)]
    learn = spark.createDataFrame(known, "doc_id long, text string, lang string")
    model = language.fit(learn)
    mixed = "the house and the garden with that thing " * 10 + "der und nicht ein über schön wasser " * 14
    tests = [(1, "the garden and that house", "en"), (2, "слово и мир", "ru"), (3, "12 -- !", "und"), (4, None, "und"), (5, "", "und"), (6, mixed, "de"), (7, "— … —", "und")]
    got = {r.doc_id: r for r in language.predict(spark.createDataFrame(tests, "doc_id long, text string, expected string"), model).collect()}
    assert {k: r.lang_pred for k, r in got.items()} == {k: e for k, _, e in tests}
    assert [s.lang for s in got[6].spans] == ["en", "de"] and all(0 <= r.score <= 1 for r in got.values())
    assert language.predict(docs, model).count() == docs.count() and language.predict(none, model).count() == 0
    assert {r.lang_pred for r in language.predict(docs, language.fit(learn.limit(0))).collect()} == {"und"}


def test_language_of_blocks_without_words(spark):
    model = language.fit(spark.createDataFrame([(i, "the house", "en") for i in range(5)], "doc_id long, text string, lang string"))
    rows_ = [(1, None), (2, ""), (3, "42"), (4, "— 7 —"), (None, None)]
    for some in (rows_[:1], rows_[:3], rows_):
        got = language.predict(spark.createDataFrame(some, "doc_id long, text string").coalesce(1), model).collect()
        assert [(r.doc_id, r.lang_pred, r.score, r.spans) for r in got] == [(i, "und", 0.0, []) for i, _ in some]


def test_viterbi_finds_the_best_of_all_paths():
    import itertools

    import numpy as np

    rng = np.random.default_rng(2)
    for n, k, penalty in ((1, 3, 2.0), (6, 3, 0.5), (7, 2, 3.0), (6, 3, 100.0)):
        scores = rng.normal(0, 2, (n, k))
        value = lambda p: sum(scores[t, p[t]] for t in range(n)) - penalty * sum(a != b for a, b in zip(p, p[1:]))  # noqa: B023,B905,E731
        assert value(language.viterbi(scores, penalty)) == pytest.approx(max(map(value, itertools.product(range(k), repeat=n))))


def test_texts_without_a_gain_need_no_viterbi():
    """The shortcut for texts of one language gives the path that stepping through them gives."""
    import numpy as np

    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(["the house", "der garten und", "слово мир", "12"], rng.integers(0, 12))) for _ in range(60)]
    letters = language.Letters(texts)
    scores = rng.normal(-5, 3, (language.TABLE, 3))
    model = language.Model(["a", "b", "c"], scores, np.ones((language.SCRIPTS, 3), bool))
    for penalty in (1.0, 10.0, 60.0):
        path, _ = language.labelled(letters, model, penalty)
        every, starts = letters.word_scores(model), letters.words.starts
        for a, b in zip(starts, starts[1:]):  # noqa: B905
            if b > a:
                best = language.viterbi(every[a:b], penalty)
                value = lambda p: every[range(a, b), p].sum() - penalty * (np.diff(p) != 0).sum()  # noqa: B023,E731
                assert value(path[a:b]) == pytest.approx(value(best))


def test_scripts_by_code_points():
    words = {"house": "latin", "дом": "cyrillic", "γη": "greek", "かな": "kana", "漢字": "han", "한국": "hangul", "नमस्ते": "devanagari", "ไทย": "thai", "தமிழ்": "tamil", "漢かな": "kana", "𠀀": "han", "…": "none"}
    found = language.Letters(list(words)).script
    assert [language.NAMES[k] for k in found] == list(words.values())


def test_lm_counts_base_and_model(docs, none):
    learn = F.crc32(F.col("doc_id").cast("string")) % 10 != 0
    got = lm.score_all(docs, learn)
    tokens = [(r[0], [*re.findall(r"[^\x20\x09-\x0D]+", (r[1] or "").translate(LOW)), None]) for r in rows()]
    counts = collections.Counter()
    for d, w in tokens:
        if d is not None and zlib.crc32(str(d).encode()) % 10:
            counts.update(w)
    n, v = sum(counts.values()), len(counts)
    want = sorted(((d, len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6)) for d, w in tokens), key=repr)
    assert sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got.collect()), key=repr) == want
    assert all(r.score < 0 for r in got.collect())
    assert lm.score_all(none, learn).count() == 0


def test_lm_weights_learn_from_every_document(spark):
    ids = [r.id for r in spark.range(9000).orderBy(F.xxhash64("id"), "id").collect()]
    texts = [(d, "up left right up" if i >= 4500 else "up left up right up" if i % 2 else "up right up left up") for i, d in enumerate(ids)]
    learn = spark.createDataFrame(texts, "doc_id long, text string").repartition(6)
    counts = lm.count_tokens(learn).cache()
    s = lm.statistics(counts)
    ask = spark.createDataFrame([(1, "up left right up"), (2, "up right left up")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm.score(ask, counts, s, lm.fit(learn, s)).collect()}
    assert got[1] > got[2] + 0.5  # "right" stands after "left" only in documents past the first 4,500


def test_lm_score_by_hand(spark):
    """Each token's probability from the model's tables, one token at a time."""
    import numpy as np

    texts = [(i, " ".join(f"w{(i * 7 + j * j) % 23}" if j % 5 else f"rare{i}{j}" for j in range(14))) for i in range(40)]
    learn = spark.createDataFrame(texts, "doc_id long, text string")
    counts = lm.count_tokens(learn).cache()
    s = lm.statistics(counts)
    s.rank = np.where(s.rank < 8, s.rank, -1)  # a small head, so that many tokens are tail ones
    ask = [(1, "w0 w5 unseen w5 rare05 w0"), (2, ""), (3, None), (4, "w1 " * 9)]
    for rounds in (1, 2):
        model = lm.fit(learn, s, rounds)
        got = {r.doc_id: r.score for r in lm.score(spark.createDataFrame(ask, "doc_id long, text string"), counts, s, model).collect()}
        known, z = dict(zip(s.known.tolist(), zip(s.counts.tolist(), s.rank.tolist(), strict=True), strict=True)), s.sizes
        share = s.tail_total + lm.ALPHA * (s.tail_distinct + 1)
        log_softmax = lambda v: v - np.log(np.exp(v).sum())
        for d, text in ask:
            tokens = lm.Tokens([text])
            total, symbols = 0.0, []
            for h, tail in zip(tokens.hashes.tolist(), tokens.tail.tolist(), strict=True):
                n, rank = known.get(h, (0, -1))
                a, b, c = ([z.head + lm.TAIL_CLASSES] * 3 + symbols)[::-1][:3]
                row = lambda kind, *x: int(lm._row(z.row_bits, kind, *[np.array([v]) for v in x])[0])  # noqa: B023,E731
                cls = rank // z.words if rank >= 0 else z.head_classes + tail
                rows_ = [row(1, a), row(2, b), row(3, c), row(4, a, b), row(5, a, c)]
                total += log_softmax(model.class_bias.astype(float) + model.classes[rows_].astype(float).sum(axis=0))[cls] / math.log(10)
                if rank >= 0:
                    rows_ = [row(6, cls, a), row(7, cls, b), row(8, cls, a, b)]
                    total += log_softmax(model.word_bias[cls].astype(float) + model.words[rows_].astype(float).sum(axis=0))[rank % z.words] / math.log(10)
                else:
                    total += math.log10((n + lm.ALPHA) / share[tail])
                symbols.append(rank if rank >= 0 else z.head + tail)
            assert got[d] == pytest.approx(total, abs=1e-4)


def test_lm_rounds_raise_the_likelihood(spark):
    learn = spark.createDataFrame([(i, " ".join(f"{'ab'[i % 2]}{(j * (1 + i % 3)) % 11}" for j in range(20))) for i in range(120)], "doc_id long, text string")
    counts = lm.count_tokens(learn).cache()
    s = lm.statistics(counts)
    total = [sum(r.score for r in lm.score(learn, counts, s, lm.fit(learn, s, rounds)).collect()) for rounds in (0, 1, 2, 4)]  # one batch, then all three
    assert total[0] < total[1] - 20 and total[1] < total[2] < total[3]


def test_lm_gradient_by_finite_differences(spark):
    """What a task adds up, observed less expected, is the slope of the log likelihood along each weight."""
    import numpy as np

    texts = [(i, " ".join(f"w{(i * 3 + j * j) % 9}" for j in range(12))) for i in range(8)]
    s = lm.statistics(lm.count_tokens(spark.createDataFrame(texts, "doc_id long, text string")))
    rng, model = np.random.default_rng(1), lm.start_model(s)
    model.classes[:] = rng.normal(0, 0.3, model.classes.shape)
    model.words[:] = rng.normal(0, 0.3, model.words.shape)
    tokens = lm.Tokens([t for _, t in texts])
    events = lm.Events(tokens, s.ranks(tokens.hashes), s.sizes)
    assert (s.ranks(tokens.hashes) == s.look_up(tokens.hashes)[1]).all() and (s.ranks(tokens.hashes + tokens.hashes.dtype.type(1)) == -1).all()
    totals = [lm.Totals(s.sizes, first) for first in (True, False)]
    for t in totals:
        t.add(events, model)
    assert all((totals[0].named()[name] == totals[1].named()[name]).all() for name in ("classes", "words"))

    def likelihood():
        wide = lm.Model(*[x.astype(np.float64) for x in (model.classes, model.words, model.class_bias, model.word_bias)])
        z, w, at = events.logits(wide, slice(None))
        return lm._own_log(z, events.cls).sum() + lm._own_log(w, events.word[at]).sum()

    for name, rows_ in (("classes", events.class_rows), ("words", events.word_rows)):
        weights, slope = getattr(model, name), totals[1].named()[name] - totals[1].named()[f"{name}_expected"]
        for row in (rows_[0][0], rows_[1][5], rows_[2][17]):
            for column in range(weights.shape[1])[:6]:
                was, ends = weights[row, column], []
                for step in (-0.01, 0.01):
                    weights[row, column] = was + step
                    ends.append((likelihood(), float(weights[row, column])))
                weights[row, column] = was
                assert (ends[1][0] - ends[0][0]) / (ends[1][1] - ends[0][1]) == pytest.approx(slope[row, column], abs=2e-3)


def test_lm_round_adds_up_what_the_softmax_expects_without_sorting(spark, monkeypatch):
    """Each event's probabilities go to the rows of all its features, whatever repeats; logits far from 0 too."""
    import numpy as np

    texts = [(i, " ".join(f"w{(i * 3 + j * j) % 9}" for j in range(12))) for i in range(8)] + [(9, "again " * 40), (10, None)]
    s = lm.statistics(lm.count_tokens(spark.createDataFrame(texts, "doc_id long, text string")))
    rng = np.random.default_rng(2)
    tokens = lm.Tokens([t for _, t in texts])
    events = lm.Events(tokens, s.ranks(tokens.hashes), s.sizes)
    for width in (0.3, 60.0):
        model = lm.start_model(s)
        model.classes[:] = rng.normal(0, width, model.classes.shape)
        model.words[:] = rng.normal(0, width, model.words.shape)
        totals, want = lm.Totals(s.sizes, False), {name: np.zeros(getattr(model, name).shape) for name in ("classes", "words")}
        with monkeypatch.context() as m:
            m.setattr(lm.np, "unique", None)
            totals.add(events, model)
        for i in range(len(events.cls)):
            kinds = [("classes", events.class_rows, model.class_bias)] + [("words", events.word_rows, model.word_bias[events.cls[i]])] * int(events.word[i] >= 0)
            for name, own, bias in kinds:
                z = bias + sum(getattr(model, name)[r[i]].astype(float) for r in own)
                p = np.exp(z - z.max())
                for r in own:
                    want[name][r[i]] += p / p.sum()
        for name, table in want.items():
            assert totals.named()[f"{name}_expected"] == pytest.approx(table, rel=1e-3, abs=1e-4)


def test_lm_sizes_follow_the_counts(spark):
    def model(n):
        s = lm.statistics(spark.range(5000).select(F.col("id").alias("token"), (F.col("id") % 32).alias("tail"), F.lit(n).cast("long").alias("n")))
        return s, lm.start_model(s)

    small, large = model(10), model(1_000_000)
    assert small[0].rank.max() == 1023 and large[0].rank.max() == 4999
    assert large[1].classes.shape[0] > small[1].classes.shape[0] and large[1].word_bias.size == large[0].sizes.head
    assert abs(math.fsum(__import__("numpy").exp(large[1].class_bias.astype(float))) - 1) < 1e-4


def test_top_k(spark):
    data = [(i, [((i * 37 + j * 11) % 100 - 50) / 40 for j in range(8)], 0) for i in range(300)]
    data += [(300, None, 0), (301, [1.0, None], 0), (302, [float("nan")] * 8, 0), (303, [], 0), (400, [9.0] * 8, 1), (400, [9.0] * 8, 1), (5, [0.5] * 8, 2), (500, [1.0, 2.0], 0), (None, [1.0] * 8, 0)]
    vectors = spark.createDataFrame(data, "vec_id long, embedding array<float>, score int").repartition(5)
    good = [(i, [math.floor(1024 * float(__import__("numpy").float32(x))) for x in v]) for i, v, _ in data if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, x in good:
        if q % 100 == 0:
            best = sorted(((-sum(a * b for a, b in zip(x, y)), i) for i, y in good if i != q))[:10]  # noqa: B905
            want += [(q, -s, i) for s, i in best]
    got = topk.top_k(vectors, vectors.where("vec_id % 100 = 0"))
    assert sorted({(r.query_id, r.score, r.vec_id) for r in got.collect() if r.query_id != 400}) == sorted({w for w in want if w[0] != 400})
    small = topk.top_k(vectors.unionByName(vectors.where("vec_id = 7")), vectors.where("vec_id % 100 = 0"), shard=40)
    want = [(q, -s, i) for q, x in good if q % 100 == 0 and q != 400 for s, i in sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in [*good, next(g for g in good if g[0] == 7)] if i != q)[:10]]  # noqa: B905
    assert sorted((r.query_id, r.score, r.vec_id) for r in small.collect() if r.query_id != 400) == sorted(want)
    assert topk.top_k(vectors.limit(0), vectors.limit(0)).count() == 0


def test_top_k_of_huge_components(spark):
    rng = __import__("random").Random(3)
    data = [(i, [rng.choice([-1, 1]) * rng.random() * 10.0 ** rng.choice([0, 3, 7, 12, 15, 200]) for _ in range(5)]) for i in range(90)]
    data += [(100, [-9e15] * 5), (200, [9e15] * 5), (300, [1.0] * 5)]
    top, low = 2**63 - 1, -(2**63)
    clip = lambda x: min(max(x, low), top)
    whole = {i: [clip(math.floor(1024 * x)) for x in v] for i, v in data}
    want = []
    for q in (0, 100, 200, 300):
        best = sorted((-clip(sum(a * b for a, b in zip(whole[q], v, strict=True))), i) for i, v in whole.items() if i != q)[:10]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    vectors = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(3)
    for shard in (32, 1000):
        got = topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), shard=shard)
        assert by_rows(got, "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)


def test_toxicity_finds_features_of_equal_leading_bits():
    import itertools

    import numpy as np

    names = ["".join(w) for w in itertools.product("abcdefghij", repeat=4)]
    hashes = lm.Words(names, toxicity.LETTERS).hashes
    model = toxicity.Model(np.sort(hashes.view(np.int64)).view(np.uint64), np.ones(len(hashes)), 0.0, 0.01)
    assert len(np.unique(hashes)) == len(names) > len(np.unique(hashes >> np.uint64(64 - 21)))
    index, _ = toxicity.Bags(names).found(model)
    assert sorted(index) == list(range(len(names)))


def test_noisy_or_and_its_gradient(spark):
    """Scores of bags sentence by sentence, and the gradient against differences of the likelihood."""
    import numpy as np

    texts = ["red fox. blue sky! red red", "grey stone? \n green leaf", "", "red leaf and blue fox. stone. stone.", "sky"]
    marks = [1, 0, 0, 1, 0]
    names = sorted(set(re.findall(r"\w+", " ".join(texts))))
    hashes = lm.Words(names, toxicity.LETTERS).hashes
    order = np.argsort(hashes)
    weights = dict(zip(names, np.linspace(-1, 3, len(names)), strict=True))

    def model(w, bias=-2.0, leak=0.05):
        return toxicity.Model(hashes[order], np.array([w[names[k]] for k in order]), bias, leak)

    def silent(text, w, bias, leak):
        out = 1 - leak
        for sentence in re.split(r"[.!?\n]", text):
            if found := re.findall(r"\w+", sentence):
                out *= 1 - 1 / (1 + math.exp(-(bias + sum(w[x] for x in found))))
        return out

    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model(weights)).collect()}
    assert [got[i] for i in range(len(texts))] == pytest.approx([1 - silent(t, weights, -2.0, 0.05) for t in texts])

    def likelihood(w, bias, leak):
        p = [1 - silent(t, w, bias, leak) for t in texts]
        return sum(math.log(x if y else 1 - x) for x, y in zip(p, marks, strict=True))

    sample = spark.createDataFrame(list(zip(texts, marks, strict=True)), "text string, label long")
    gradient = toxicity._gradient(toxicity._compact(sample, model(weights)), model(weights))
    step = 1e-5
    for place, k in enumerate(order):
        up, down = ({**weights, names[k]: weights[names[k]] + d} for d in (step, -step))
        assert gradient[place] == pytest.approx((likelihood(up, -2.0, 0.05) - likelihood(down, -2.0, 0.05)) / (2 * step), abs=1e-4)
    assert gradient[-2] == pytest.approx((likelihood(weights, -2.0 + step, 0.05) - likelihood(weights, -2.0 - step, 0.05)) / (2 * step), abs=1e-4)


def test_toxicity_round_is_a_few_jobs_whatever_the_partitions(spark):
    """A local iterator ran a job for each shuffle partition in every round of training."""
    import numpy as np

    names = [f"word{i}" for i in range(300)]
    model = toxicity.Model(np.sort(lm.Words(names, toxicity.LETTERS).hashes), np.ones(300), -2.0, 0.05)
    sample = spark.createDataFrame([(" ".join(names), 1), ("word1 word2", 0)], "text string, label long")
    compact = toxicity._compact(sample, model).cache()
    compact.count()
    changed = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in changed}
    sc = spark.sparkContext
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        first = int(sc._jsc.sc().dagScheduler().nextJobId())
        toxicity._gradient(compact, model)
        assert int(sc._jsc.sc().dagScheduler().nextJobId()) - first < 5
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        compact.unpersist()


def test_what_the_driver_sums_up_comes_by_a_few_jobs(spark):
    """A local iterator ran a job for each range of the suffix array and for each partition of the terms' counts."""
    changed = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in changed}
    scheduler = spark.sparkContext._jsc.sc().dagScheduler()
    texts = spark.createDataFrame([(1, A), (2, B), (3, f"{A} alpha1")], "doc_id long, text string")
    places = [(i % 60, i, 0, i, i, 0, [i % 60, i % 7, i]) for i in range(400)]
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        indexed = decontaminate.index(texts).cache()
        indexed.count()
        phrases = next(decontaminate.passes(decontaminate.blocks(spark.createDataFrame([(1, "alpha1 beta1 gamma7 nowhere")], "item_id long, text string"))))
        tails = spark.createDataFrame(places, "rank long, doc long, twin long, at int, seg long, i int, tail array<long>").cache()
        tails.count()
        first = int(scheduler.nextJobId())
        counts = decontaminate.term_counts(indexed, phrases)
        assert int(scheduler.nextJobId()) - first < 5
        first = int(scheduler.nextJobId())
        found = lines.longest_earlier(tails)
        assert int(scheduler.nextJobId()) - first < 12
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        indexed.unpersist()
    words = collections.Counter(w for t in (A, B, f"{A} alpha1") for w in t.split())
    assert dict(zip(phrases[0].value.terms, counts[0].tolist(), strict=True)) == {w.encode(): words[w] for w in "alpha1 beta1 gamma7 nowhere".split()}
    run = lambda i, j: next((n for n in range(3) if places[i][6][n] != places[j][6][n]), 3)
    want = [(i, 0, most) for i in range(400) if (most := max((run(i, j) for j in range(i % 60, i, 60)), default=0))]
    assert by_rows(found, "seg", "i", "run") == sorted(want, key=repr)
    tails.unpersist()


def test_workers_get_small_batches(spark, tmp_path):
    """A batch holds two large blocks of text, not 4 MB: the JVM has its copies outside the heap."""
    import pyarrow as pa

    from tidemark.llm import common

    spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.col("id").cast("string"), 600).alias("text")).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["rows", "bytes"])

    got = common.read(spark, str(tmp_path), "documents").mapInArrow(run, "rows long, bytes long").collect()
    assert sum(r.rows for r in got) == 4000 and max(r.bytes for r in got) < 1_200_000


def test_toxicity(spark, docs, none):
    plain, bad = "a quiet day in the park with birds. ", "you are a wretchling indeed. "
    known = [(i, plain * (1 + i % 5) + (bad if i % 3 == 0 else "") + plain, int(i % 3 == 0)) for i in range(90)]
    texts = spark.createDataFrame([(i, t) for i, t, _ in known], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in known] + [(0, 0), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(texts, labels)
    got = {r.doc_id: r for r in toxicity.score(texts, model).collect()}
    assert all((got[i].score >= 0.5) == bool(y) for i, _, y in known)
    assert known[3][1].encode()[got[3].begin : got[3].end].decode().startswith("you are a wretchling")
    clean = toxicity.without_toxic(docs, model)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    assert toxicity.score(none, model).count() == 0
    assert all(0 <= r.score <= 1 for r in toxicity.score(docs, toxicity.fit(texts, labels.limit(0))).collect())


def test_urls(spark):
    pages = [(1, "https://WWW.Example.org/es/9?x", "example.org/es/", "block"), (2, "http://a.org/", "org/", "allow"), (3, "http://a.org", None, "allow"), (4, "ftp://example.org/en/12#f", "example.org/en/1", "block"), (5, None, None, "allow"), (6, "no url", None, "allow"), (7, "http://x.com/de/1", "com/de/", "block"), (8, "http://notexample.org/es/", "org/", "allow")]
    train = [(100 + i, f"http://s{i % 4}.com/{'de' if i % 2 else 'fr'}/{i}", None, "") for i in range(80)]
    df = spark.createDataFrame([(i, u, "c") for i, u, _, _ in [*pages, *train]] + [(9, "http://s1.net/de/77", "c"), (9, "http://s1.net/de/77", "c")], "page_id long, url string, host string")
    got = urls.judge(df)
    found = [(r.page_id, r.rule, r.verdict) for r in got.collect() if r.page_id < 9]
    assert sorted(found) == [(i, rule, verdict) for i, _, rule, verdict in pages]
    assert [(r.host, r.path, r.verdict) for r in got.where("page_id = 9").collect()] == [("s1.net", "/de/77", "block")] * 2
    assert urls.judge(df.limit(0)).count() == 0


def url_tokens(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(LOW), m[2]) if m else ("", "")
    query = re.search(r"\?([^#]*)", url or "")
    mask = lambda t: re.sub(r"[0-9]+", "0", t)
    parts = [f"h:{mask(x)}" for x in host.split(".") if x] + [f"p:{mask(x)}" for x in path.split("/") if x]
    return host, path, frozenset(parts + [f"q:{mask(x.split('=')[0])}" for x in (query[1] if query else "").split("&") if x])


def listed_verdict(host, path):
    fits = [(len(t), t, w) for w, t in urls.RULES if (host == t.split("/")[0] or host.endswith("." + t.split("/")[0])) and path.startswith("/" + t.partition("/")[2])]
    return max(fits)[1:] if fits else (None, None)


def test_urls_of_many_tokens_that_stand_together(spark):
    """Forty segments on one labelled address, forty more on another: each lot is one item."""
    block, allow = ("/".join(f"{c}seg{'xyz'[i % 3] * (i + 1)}" for i in range(40)) for c in "pq")
    pages = [(i, f"http://s{i}.com/de/{block}") for i in range(30)] + [(100 + i, f"http://s{i}.com/fr/{allow}") for i in range(30)]
    pages += [(200, f"http://x.net/{block}"), (201, f"http://x.net/{allow.split('/')[7]}"), (202, "http://x.net/psegyy"), (203, f"http://x.net/{allow}/{block}"), (204, "http://y.net/other")]
    got = {r.page_id: (r.verdict, r.confidence) for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string")).collect()}
    assert [got[k] for k in (200, 201, 202, 204)] == [("block", 1.0), ("allow", 1.0), ("block", 1.0), ("allow", None)] and got[203][0] == "block" and len(got) == len(pages)


def test_url_rules_by_brute_force(spark):
    """Every itemset counted, every rule of enough support and confidence tried on every page."""
    import itertools
    import random

    rng = random.Random(11)
    ends = ["com/de", "com/fr", "org/es", "net/x"]
    pages = [(i, f"https://{rng.choice('abc')}{rng.randint(1, 3)}.example.{rng.choice(ends)}/{rng.choice(['news', 'shop', 'news/7'])}?{rng.choice(['id=1', 'q=2&id=3', ''])}") for i in range(160)]
    pages += [(900, None), (901, ""), (902, "http://x.net/" + "a/" * 3000), (903, pages[0][1]), (903, pages[0][1])]
    sets = {url: url_tokens(url) for _, url in pages}
    labelled = [(sets[u][2], listed_verdict(*sets[u][:2])[1]) for _, u in pages]
    labelled = [(t, y) for t, y in labelled if y and t]
    support, n = collections.Counter(), len(labelled)
    for tokens, y in labelled:
        for size in range(1, len(tokens) + 1):
            for some in itertools.combinations(sorted(tokens), size):
                support[frozenset(some)] += 1
                support[frozenset(some), y] += 1
    rules = []
    for key, both in support.items():
        if isinstance(key, tuple) and both >= n * urls.MIN_SUPPORT and both / support[key[0]] >= urls.MIN_CONFIDENCE:
            rules.append((both / support[key[0]], both / n, key[1], key[0]))
    want = []
    for i, url in pages:
        host, path, tokens = sets[url]
        rule, verdict = listed_verdict(host, path)
        best = max(((c, s, y) for c, s, y, needed in rules if needed <= tokens), default=None) if verdict is None else None
        want.append((i, host, path, rule, verdict or (best[2] if best else "allow")))
    got = urls.judge(spark.createDataFrame(pages, "page_id long, url string"))
    assert by_rows(got, "page_id", "host", "path", "rule", "verdict") == sorted(want, key=repr)
    assert {"block", "allow"} <= {w[4] for w in want if w[3] is None}


def brute_pipeline(data, bench, model):
    """The pipeline's rows in plain Python; the toxicity of a text is the learned model's."""
    kept = [(d, t) for d, t in data if model(t) < 0.5]
    cut = brute_lines(kept, 50)
    kept = [(d, t if t is None else cut[2**63 - 1 if d is None else d, t], t) for d, t in kept]
    kept = [(d, t) for d, t, old in kept if t == old or (t and t.strip())]
    sets = [(d, shingles(t, 5)) for d, t in kept]
    parent = {d: d for d, _ in kept}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (d, x), (e, y) in ((a, b) for a in sets for b in sets if a[0] < b[0] and a[1] and b[1]):
        if 100 * len(x & y) >= 80 * len(x | y):
            a, b = sorted((find(d), find(e)))
            parent[b] = a
    kept = [(d, t) for (d, t), (_, x) in zip(kept, sets, strict=True) if not x or find(d) == d]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    windows = {tuple(words(t)[i : i + 10]) for _, t in bench for i in range(max(1, len(words(t)) - 9)) if words(t)}
    held = lambda w: any(tuple(w[i : i + len(x)]) == x for x in windows for i in range(len(w) - len(x) + 1))
    kept = [(d, t) for d, t in kept if not held(words(t))]
    known = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks(), special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return [(d, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())) for d, t in kept for ids in [known.encode_ordinary(t or "")]]


def test_pipeline_by_brute_force(spark, tmp_path):
    import corpus_pipeline

    own = lambda k, n=80: " ".join(f"own{k}word{j}" for j in range(n))
    passage = "\n".join(" ".join(f"pass{i}x{j}" for j in range(15)) for i in range(5))
    question = " ".join(f"quiz{j}" for j in range(14))
    bad = "what a wretched hagglewort you are"
    data = [(i, own(i)) for i in range(20)]
    data += [(100, own(3)), (101, own(4) + " tail"), (102, own(5).replace("own5word20", "other"))]  # an exact copy, two near ones
    data += [(110, f"{own(110)}\n{passage}\n{own('a')}"), (111, f"{own(111)}\n{passage}\n\n{own('b')}"), (112, passage)]  # repeated lines
    data += [(120, f"{own(120)} {question} {own('c')}"), (121, f"{own(121)} {' '.join(question.split()[2:12])}"), (122, f"{own(122)} {' '.join(question.split()[:9])}")]  # benchmark
    data += [(200 + i, f"{own(200 + i)}. {bad}. {own(i)}" if i % 2 else f"{own(200 + i)}. fine day. {own(300 + i)}") for i in range(60)]
    data += [(400, None), (401, ""), (402, " \n"), (403, "12 7"), (404, LONG)]
    labels = [(200 + i, 1, i % 2) for i in range(60)]
    bench = [(1, question), (2, None), (3, "")]

    def write(folder, data):
        spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in data], "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame(labels if data else [], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame(bench if data else [], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    write(tmp_path / "some", data)
    docs, marks = (spark.read.parquet(f"{tmp_path}/some/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(toxicity.learnable(docs), toxicity.learnable(marks))
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    by_text = {t: scores[d] for d, t in data}
    want = brute_pipeline(data, bench, by_text.__getitem__)
    got = corpus_pipeline.run(spark, f"{tmp_path}/some")
    assert by_rows(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    kept = {w[0] for w in want}
    assert not kept & {100, 101, 102, 112, 120, 121} and not kept & {201 + i for i in range(0, 60, 2)}
    assert kept >= {*range(20), 110, 111, 122, *(200 + i for i in range(0, 60, 2)), 400, 401, 402, 403, 404}
    write(tmp_path / "none", [])
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_pipeline_stages_on_nulls(spark, tmp_path):
    """Blocks without a word, null ids and repeated rows pass every stage."""
    import corpus_pipeline

    rows_ = [(None, None), (None, "a b"), (None, "a b"), (1, None), (1, None), (2, "same"), (2, "same"), (3, "—")]
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.createDataFrame(rows_, "doc_id long, text string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == ["doc_id", "text"], name
    assert sorted((tuple(r) for r in now.collect()), key=repr) == sorted([(None, None), (None, "a b"), (None, "a b"), (1, None), (1, None), (2, "same"), (3, "—")], key=repr)


def test_pipeline_stages_keep_columns(spark, docs, tmp_path):
    import corpus_pipeline

    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(2, "zz yy xx")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(0, 1, 0), (3, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, str(tmp_path))
        assert after.columns == now.columns, name
    out = corpus_pipeline.run(spark, str(tmp_path))
    ids = [r.doc_id for r in out.collect()]
    assert 0 in ids and 1 not in ids and out.columns[0] == "doc_id"
