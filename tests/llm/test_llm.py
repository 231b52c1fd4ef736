"""Every operator and the pipeline against plain code, on awkward, tiny and empty tables."""

import random
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
import plain
from evalspark.llm import bpe, fmindex, language, linededup, maxent, pii, queries, resync, rules, simhash, weak

SF = "/root/testdata/sf0.001"
rnd = random.Random(7)
VOCABULARY = ["".join(rnd.choices("abcdeiou", k=rnd.randint(1, 6))) for _ in range(300)]


def prose(n, lines=1):
    return "\n".join(" ".join(rnd.choices(VOCABULARY, k=n // lines)) for _ in range(lines))


PASSAGE, LONG_LINE = prose(70, 4), prose(55)
ITEM = prose(24)
TEXTS = [
    None, "", " \n\t ", "one", "one two", "A b C", prose(5), prose(5),
    prose(80, 4), prose(120, 6) + "\n" + PASSAGE, PASSAGE, "x\n\n" + PASSAGE.replace("\n", "\n\n") + "\nend", PASSAGE + "\n" + PASSAGE,
    LONG_LINE, "start\n" + LONG_LINE + " \r\nstop", LONG_LINE + "\n" + LONG_LINE,
    prose(400, 9), "word " * 60, "Say, " + ITEM.upper() + "! and " + prose(30), ITEM, ITEM + " " + ITEM, " ".join(ITEM.split()[3:15]), " ".join(ITEM.split()[:9]),
    "tiny item here", "a tiny item here too", "日本語 テキスト " * 9, "İstanbul ÀÉ ǅ Σας " * 4, "é" * 3000, "<|endoftext|> it's <|startoftext|>x", "a\x1cb\x85c d\xa0e f",
    "mail a.b@c.de.fg and a@b.co_x@d.ef 1.2.3.4.5.6.7.8 300.1.1.1 000.255.1.01", "card 4111 1111 1111 1111, 4111-1111-1111-1112 and +1 (826) 555-4081 190.137.213.85",
    "+" + "1" * 30, "1 " * 4000, "a." * 3000 + "@" + "b." * 3000, "9" * 5000, "((((" * 2000, "+1 234 567 8901",
    "idiot loser " + prose(40), "| " * 30, "NO!! WAY!! " * 9, prose(2500, 40) + "\n" + PASSAGE,
]
near = TEXTS[16].split()
for k in range(12):
    near[k * 9] = "zz"
    TEXTS.append(" ".join(near))
ROWS = [(i, t) for i, t in enumerate(TEXTS)] + [(100, TEXTS[9]), (100, TEXTS[9]), (9, TEXTS[9]), (None, TEXTS[16]), (None, None), (3, "two rows, one id")]


def write(path, rows, items, labels):
    n = len(rows)
    extra = {c: pa.array([rnd.choice([None, c]) for _ in rows], pa.string()) for c in ("rid", "block", "words", "held_out", "ids", "row", "kind", "count", "rank", "spans", "n_words", "fp", "_rid", "removed", "n_removed", "measures")}
    table = {
        "doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.string()),
        "lang": pa.array([rnd.choice([None, "en", "xx"]) for _ in rows], pa.string()), "source": pa.array([None] * n, pa.string()), "n_chars": pa.array([None] * n, pa.int64()),
    }
    pq.write_table(pa.table(table | extra), f"{path}/documents.parquet", row_group_size=16)
    pq.write_table(pa.table({"item_id": pa.array([i for i, _ in items], pa.int64()), "text": pa.array([t for _, t in items], pa.string()), "items": pa.array([None] * len(items), pa.string())}), f"{path}/benchmark.parquet")
    pq.write_table(pa.table({c: pa.array([x[k] for x in labels], pa.int64()) for k, c in enumerate(("doc_id", "quality", "toxic"))}), f"{path}/labels.parquet")
    return str(path)


ITEMS = [(1, ITEM), (1, ITEM), (2, "Tiny, item here"), (None, ITEM[:80]), (3, None), (4, " !"), (12, " ".join(ITEM.split()[5:20]))]
LABELS = [(i, i % 2, int(i % 9 == 0)) for i in range(0, 40, 2)] + [(None, 1, 0), (4, None, None), (6, 0, 1)]


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    return write(tmp_path_factory.mktemp("odd"), ROWS, ITEMS, LABELS)


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    return write(tmp_path_factory.mktemp("empty"), [], [], [])


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(queries.tokenizer_path())


def bag(rows):
    return Counter(map(repr, rows))


def got(spark, name, path, *columns):
    return [tuple(r[c] for c in columns) for r in queries.QUERIES[name](spark, path).collect()]


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_empty_tables(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).collect() == []


def test_empty_pipeline(spark, empty):
    assert corpus_pipeline.run(spark, empty).collect() == []


@pytest.mark.parametrize("where", ["odd", SF])
def test_lm_base(spark, odd, where):
    path = odd if where == "odd" else where
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    out = queries.QUERIES["op1_lm_score"](spark, path).collect()
    want = [(i, *x[:4], round(x[4], 5)) for (i, _), x in zip(rows, plain.base_scores(rows))]
    assert bag((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in out) == bag(want)
    assert all(r["score"] < 0 for r in out)


def test_lm_beats_its_base_on_unseen_texts(spark):
    out = [r for r in queries.QUERIES["op1_lm_score"](spark, "/root/testdata/sf0.01").collect() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_lm_is_a_distribution():
    counts = maxent.Counts([(maxent.END, 5), (b"a", 9), (b"b", 2)], 20, 6)
    m = maxent.Model(counts)
    m.by_class += 0.1 * (maxent.np.arange(m.by_class.size).reshape(m.by_class.shape) % 7)
    seq = maxent.np.arange(maxent.VOCABULARY + 1)
    same = maxent.np.zeros((3, len(seq)), maxent.np.int64) + 5
    assert abs((10 ** maxent.score_symbols(m, seq, same)).sum() - 1) < 1e-3


def test_language(spark, odd):
    assert len(got(spark, "op2_language_id", odd, "doc_id")) == len(ROWS)
    for i, pred, score in got(spark, "op2_language_id", odd, "doc_id", "lang_pred", "score"):
        assert pred in ("en", "xx", "und") and 0 <= score <= 1
        if i in (0, 1, 2, 33, 35, 36):
            assert (pred, score) == ("und", 0.0)
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    out = got(spark, "op2_language_id", "/root/testdata/sf0.01", "doc_id", "held_out", "lang_pred")
    assert all(h == (plain.remainder(i, 4) == 2) for i, h, _ in out)
    unseen = [lang[i] == p for i, h, p in out if h]
    assert sum(unseen) >= 0.97 * len(unseen)


def test_kernel_is_the_share_of_common_grams():
    x = language.np.array([language.presence(t) for t in ("abc abd", "abc abd abc!", "xyz", "")])
    k = language._kernel(x, x)
    assert k[0, 0] > 0.999 and 0.8 < k[0, 1] < 1 and k[0, 2] < 0.4 and not k[3].any()


def test_language_of_very_long_texts():
    r = random.Random(5)

    def writer(first, letters, blank):
        words = ["".join(chr(first + r.randrange(letters)) for _ in range(r.randint(1, 7))) for _ in range(3000)]
        return lambda n: blank.join(r.choices(words, k=n))

    write = {"c1": writer(0x4E00, 9000, ""), "c2": writer(0x6000, 9000, ""), "l1": writer(ord("a"), 20, " "), "l2": writer(ord("g"), 20, " ")}
    train = [(k, r.randint(5, 600)) for k in write for _ in range(60)]
    parts = [language.pieces(write[k](n)) for k, n in train]
    x = language.np.array([language._bits(r.choice(p)) for p in parts])
    y = language.np.array([list(write).index(k) for k, _ in train])
    model = language.Model(list(write), x[::3], x, y)
    texts = [write[k](n) for k in write for n in (20_000, 800_000)]
    assert min(map(len, texts)) > 70_000 and max(map(len, texts)) > 3_000_000
    pred, score = model.predict([*texts, "", None])
    assert pred == [k for k in write for _ in range(2)] + ["und"] * 2
    assert min(score[:-2]) > 0.75
    # the whole text counts: the longer part wins, wherever it is
    a, b = write["l1"](200_000), write["l2"](100_000)
    assert model.predict([a + b, b + a])[0] == ["l1", "l1"]
    assert max(language._bits(p).mean() for t in texts for p in language.pieces(t)) < 0.5


def test_quality_rules(spark, odd):
    out = got(spark, "op3_quality_rules", odd, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert bag(out) == bag((i, *plain.rule_counts(t)) for i, t in ROWS)
    assert not any(k for f, k in got(spark, "op3_quality_rules", odd, "base_failed", "kept") if f)


def test_cutoffs_keep_their_promise(spark):
    from fractions import Fraction
    from math import comb

    for n, k, p in ((10, 3, 0.3), (200, 1, 0.02), (500, 20, 0.02), (50, 0, 0.01), (5, 5, 0.2), (3000, 30, 0.02)):
        exact = sum(comb(n, i) * Fraction(p) ** i * (1 - Fraction(p)) ** (n - i) for i in range(k + 1))
        assert abs(rules.binomial_cdf(k, n, p) - float(exact)) < 1e-9
    path = "/root/testdata/sf0.1"
    rows = rules.measured(spark.read.parquet(f"{path}/documents.parquet"), "doc_id")
    labels = spark.read.parquet(f"{path}/labels.parquet")
    table = rules.cutoffs(rows, labels, alpha=0.05)
    assert any(table.values())
    lost = rows.join(labels, "doc_id").filter("quality = 1").filter(~rules.base_failed()).groupBy("lang").agg({"*": "count"})
    n = {r["lang"]: r["count(1)"] for r in lost.collect()}
    bad = rows.join(labels, "doc_id").filter("quality = 1").filter(~rules.base_failed() & ~rules.kept(table)).groupBy("lang").count().collect()
    assert all(r["count"] <= 0.05 * n[r["lang"]] for r in bad)


def test_line_dedup(spark, odd):
    out = linededup.dedup_lines(spark.read.parquet(f"{odd}/documents.parquet")).collect()
    assert bag((r["doc_id"], r["text"], r["n_removed"]) for r in out) == bag((i, *x) for (i, _), x in zip(ROWS, plain.cleaned_lines(ROWS)))
    assert {"rid", "rank", "words"} <= set(out[0].asDict())


def test_bpe(spark, odd, tok):
    out = got(spark, "op5_bpe_encode_decode", odd, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    ids = [tok.encode(t or "", add_special_tokens=False).ids for _, t in ROWS]
    assert bag(out) == bag((i, len(x), plain.ids_hash(x), plain.sha(tok.decode(x, skip_special_tokens=False))) for (i, _), x in zip(ROWS, ids))


@pytest.mark.parametrize("chunk,overlap", [(resync.CHUNK, resync.OVERLAP), (300, 7), (64, 64)])
def test_token_counts(spark, odd, tok, chunk, overlap):
    out = resync.token_counts(spark.read.parquet(f"{odd}/documents.parquet"), queries.tokenizer_path(), 50, chunk, overlap).collect()
    n = [len(tok.encode(t or "", add_special_tokens=False).ids) for _, t in ROWS]
    assert bag((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in out) == bag((i, len((t or "").encode()), k, k > 50) for (i, t), k in zip(ROWS, n))


def test_simhash(spark, odd):
    out = got(spark, "op7_simhash_near_dedup", odd, "doc_id", "fingerprint", "component_id")
    prints = [plain.fingerprint(t) for _, t in ROWS]
    group = plain.groups(prints)
    least = {g: min((i for (i, _), h in zip(ROWS, group) if h == g and i is not None), default=None) for g in group}
    assert bag(out) == bag((i, f"{p:016x}", least[g]) for (i, _), p, g in zip(ROWS, prints, group))


def test_simhash_crowded_anchors(spark, monkeypatch):
    """The second cover finds the same groups as the first."""
    center = rnd.getrandbits(64)
    prints = {center} | {rnd.getrandbits(64) for _ in range(100)}
    while len(prints) < 700:
        x = rnd.choice(sorted(prints))
        for b in rnd.sample(range(64), rnd.randint(1, 4)):
            x ^= 1 << b
        prints.add(x)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    want = Counter(Counter(plain.groups([p % (1 << 64) for p in signed])).values())
    for hot, small in ((simhash.HOT, simhash.SMALL), (3, 2)):
        monkeypatch.setattr(simhash, "HOT", hot)
        monkeypatch.setattr(simhash, "SMALL", small)
        root = {p: p for p in signed}
        for r in simhash.links(df).collect():
            assert ((r["a"] ^ r["b"]) % (1 << 64)).bit_count() <= 3
        sizes = Counter(r["root"] for r in simhash.components(simhash.links(df)).collect())
        alone = len(root) - sum(sizes.values())
        assert Counter(sizes.values()) + Counter({1: alone}) == want


def test_weak_labels(spark, odd):
    out = got(spark, "op8_quality_classifier", odd, "doc_id", "junk_weak", "toxic_weak", "junk_score", "toxic_score", "kept")
    assert bag(x[0] for x in out) == bag(i for i, _ in ROWS)
    assert all(0 <= p <= 1 for x in out for p in x[1:5])
    labels = {r["doc_id"]: r for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    scored = got(spark, "op8_quality_classifier", "/root/testdata/sf0.1", "doc_id", "junk", "toxic")
    clean = [(j, t) for i, j, t in scored if i in labels and labels[i]["quality"] == 1 and labels[i]["toxic"] == 0]
    junk = [j for i, j, _ in scored if i in labels and labels[i]["quality"] == 0]
    assert sum(j or t for j, t in clean) <= 0.05 * len(clean) and sum(junk) >= 0.9 * len(junk)


def test_em_finds_accuracies():
    truth = [rnd.random() < 0.2 for _ in range(20000)]
    right = (0.95, 0.8, 0.7, 0.9)
    counts = Counter(sum((int(t) if rnd.random() < a else 1 - int(t)) * 3**k for k, a in enumerate(right)) for t in truth)
    _, table = weak.estimate(dict(counts), 4)
    assert all(abs(table[1, k, weak.YES] - a) < 0.05 for k, a in enumerate(right))


def test_decontamination(spark, odd, monkeypatch):
    phrases = plain.windows(ITEMS)
    want = [(i, n, len(h), len(s), plain.sha(",".join(sorted(s))), bool(h)) for (i, t) in ROWS for n, h, s in [plain.hits(t, phrases)]]
    for block in (fmindex.BLOCK, 3):
        monkeypatch.setattr(fmindex, "BLOCK", block)
        assert bag(got(spark, "op9_benchmark_decontamination", odd, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) == bag(want)
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    cut = fmindex.decontaminate(docs, spark.read.parquet(f"{odd}/benchmark.parquet"))
    assert cut.columns == docs.columns
    assert bag((r["doc_id"], r["text"]) for r in cut.collect()) == bag((i, plain.without(t, plain.hits(t, phrases)[1])) for i, t in ROWS)


@pytest.mark.parametrize("where", ["odd", "/root/testdata/sf0.01"])
def test_personal_data(spark, odd, where):
    path = odd if where == "odd" else where
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    want = [(i, *(sum(x.startswith(k + ":") for x in s) for k in pii.KINDS), plain.sha(",".join(s))) for i, t in rows for s in [plain.personal(t)]]
    out = queries.QUERIES["op10_personal_data"](spark, path).collect()
    assert bag((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in out) == bag(want)
    base = {(i, x) for i, t in rows for x in plain.personal(t)}
    assert base <= {(r["doc_id"], x) for r in out for x in r["spans"].split(",") if x}


def test_pipeline(spark, odd, tok):
    labels = spark.read.parquet(f"{odd}/labels.parquet")
    table = rules.cutoffs(rules.measured(spark.read.parquet(f"{odd}/documents.parquet"), "doc_id"), labels)
    assert not any(table.values())  # so few labels prove nothing: the base rule alone decides
    rows = [(i, t) for i, t in ROWS if not plain.rule_counts(t)[-1]]
    rows = [(i, t) for (i, _), (t, _) in zip(rows, plain.cleaned_lines(rows))]
    group = plain.groups([plain.fingerprint(t) for _, t in rows])
    first = {}
    for k, ((i, _), g) in enumerate(zip(rows, group)):
        first[g] = min(first.get(g, (True, 0, 1 << 60)), (i is None, i or 0, k))
    rows = [rows[k] for _, _, k in sorted(first.values(), key=lambda x: x[2])]
    phrases = plain.windows(ITEMS)
    rows = [(i, plain.without(t, plain.hits(t, phrases)[1])) for i, t in rows]
    out = corpus_pipeline.run(spark, odd).collect()
    assert bag((r["doc_id"], r["n_tokens"], plain.sha(bytes(r["ids"])), r["decoded"]) for r in out) == bag(
        (i, len(x), plain.ids_hash(x), tok.decode(x, skip_special_tokens=False)) for i, t in rows for x in [tok.encode(t or "", add_special_tokens=False).ids]
    )


@pytest.mark.parametrize("where", ["odd", SF])
def test_pipeline_keeps_the_columns(spark, odd, where):
    docs = spark.read.parquet(f"{odd if where == 'odd' else SF}/documents.parquet")
    if where == "odd":
        given = {(r["doc_id"], r["text"], c, r[c]) for r in docs.collect() for c in ("_rid", "removed", "n_removed", "measures", "spans", "row")}
        stay = corpus_pipeline.materialize(simhash.one_of_each(linededup.dedup_lines(docs, names=("cut", "n_cut"))), "stay").collect()
        # texts change, callers' columns do not
        assert {(r["doc_id"], c, r[c]) for r in stay for c in ("_rid", "removed", "n_removed", "measures")} <= {(i, c, v) for i, _, c, v in given}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.materialize(stage(spark, docs, odd if where == "odd" else SF), name)
        assert after.dtypes == docs.dtypes and after.count() <= docs.count()
        docs = after


def test_decoding_refuses_other_rules(spark, tmp_path):
    t = Tokenizer.from_file(queries.tokenizer_path())
    from tokenizers import decoders

    t.decoder = decoders.BPEDecoder()
    t.save(str(tmp_path / "t.json"))
    with pytest.raises(ValueError):
        bpe.decode(spark.createDataFrame([(1, bytearray(b""))], "doc_id long, ids binary"), str(tmp_path / "t.json"))


def test_dropped_candidates_cover_nothing(spark):
    spans = [(1, 0, 10), (1, 8, 20), (1, 18, 30), (1, 30, 35), (1, 28, 40), (2, 5, 9), (2, 5, 12), (2, 11, 15), (2, 12, 14)]
    rows = spark.createDataFrame([(r, "phone", lo, hi, "groups") for r, lo, hi in spans], "rid long, as_kind string, lo long, hi long, by string")
    # of a chain the third is kept, as nothing kept covers it
    assert sorted(tuple(x) for x in pii._apart(rows).select("rid", "lo", "hi").collect()) == [(1, 0, 10), (1, 18, 30), (1, 30, 35), (2, 5, 12), (2, 12, 14)]


def test_words_of_many_texts_are_encoded_together(monkeypatch):
    """Each unknown word of a slice is encoded once, in one call; a full memo starts afresh and counts stay right."""
    from evalspark.llm import queries as q, tokens

    with open(q.tokenizer_path(), encoding="utf-8") as f:
        counts = tokens.Counts(f.read())
    texts = [f"word{k % 5} other, {k} \x0b naïve-{k % 3}  ".encode().split() for k in range(40)] + [[]]
    want = [sum(len(counts.tok.encode(w.decode(), add_special_tokens=False).ids) for w in t) for t in texts]
    asked, tok = [], counts.tok

    class Seen:
        def encode_batch_fast(self, words, **options):
            asked.append(list(words))
            return tok.encode_batch_fast(words, **options)

    counts.tok = Seen()
    assert counts.of(texts) == want
    assert len(asked) == 1 and len(set(asked[0])) == len(asked[0]) == len(set().union(*texts))
    monkeypatch.setattr(tokens, "COUNTS", 3)
    assert counts.of(texts[:7]) == want[:7] and len(asked) == 1
    assert counts.of([[b"unseen"], *texts[:7]])[1:] == want[:7]
    assert len(counts.memo) == len({b"unseen"}.union(*texts[:7]))
