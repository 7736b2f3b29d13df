"""Text operators where a corpus goes beyond what the given tables hold."""

import collections
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelspark.llm import minhash, pii, pq, substring, suffix


@pytest.mark.parametrize("letters, gender, n", [("abcdefghijklmnopqrstuvwxyz", "m", 15_000), (pii.CYRILLIC, "f", 7_000)])
def test_more_names_than_the_first_attempt_has(spark, letters, gender, n):
    k = len(letters)
    names = [letters[i % k] + letters[i // k % k] + letters[i // k // k] * 2 for i in range(n)]
    ents = spark.createDataFrame([("person", x, gender) for x in names], "kind string, canon string, gender string")
    late = pii.attempts(ents, "k")
    m = ents.join(late, ["kind", "canon"], "left").withColumn("attempt", F.coalesce("attempt", F.lit(0)))
    subs = [r[0] for r in m.select(pii.surrogate("k", F.col("kind"), F.col("canon"), F.col("attempt"), F.col("gender"))).collect()]
    assert len(set(subs)) == n and not set(subs) & set(names)


def test_entities_that_are_all_their_format_has_get_longer_surrogates(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    real = {f"{a}@{b}.io" for a in letters for b in letters}
    rows = [(i, f"write {e.upper() if i % 2 else e} now") for i, e in enumerate(sorted(real))]
    got = pii.replace(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), key="k").collect()
    subs = [r.entities[0].surrogate.lower() for r in got]
    assert len(set(subs)) == 676 and not set(subs) & real and all(x.endswith(".io") and x.count("@") == 1 for x in subs)
    assert all(r.text == f"write {r.entities[0].surrogate} now" for r in got)


def test_the_key_of_the_session_is_drawn_once_and_can_be_set(spark):
    spark.conf.unset(pii.KEY_CONF)
    one = pii.session_key(spark)
    assert len(one) == 64 and pii.session_key(spark) == one
    spark.conf.set(pii.KEY_CONF, "mine")
    df = spark.createDataFrame([(1, "a@b.org")], "doc_id long, text string")
    assert pii.replace(df).first().text == pii.replace(df, key="mine").first().text
    spark.conf.unset(pii.KEY_CONF)


def test_vectors_of_null_and_repeated_keys(spark):
    a, b, c = [1.0, 0.0, 0.0], [0.999, 0.01, 0.0], [0.0, 1.0, 0.0]
    rows = [(None, a, 1), (5, b, 1), (None, c, 1), (7, a, 1), (7, c, 1), (3, c, 2), (None, [0.0, 0.0, 1.0], 1), (None, None, 1), (9, [0.0] * 3, 1)]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "vec_id long, embedding array<double>, label int, n_links int, rep string")
    got = collections.Counter(map(tuple, pq.near_duplicates(df).collect()))
    # (None, a), (5, b), (7, a) are one component; (None, c) and (7, c) another
    want = [(None, 2, 5, False), (5, 2, 5, True), (7, 2, 5, False), (None, 1, 7, False), (7, 1, 7, True), (3, 0, 3, True), (None, 0, None, True), (None, 0, None, True), (9, 0, 9, True)]
    assert got == collections.Counter(want)
    assert pq.near_duplicates(df.limit(0)).count() == 0


def linked(rows, cosine=0.98):
    """{key: (n_links, component_id)} by all pairs."""
    x = np.array([r[1] for r in rows], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    label = np.array([str(r[2]) for r in rows])
    link = (x @ x.T >= cosine) & (label[:, None] == label[None, :])
    np.fill_diagonal(link, False)
    comp = np.array([r[0] for r in rows])
    while True:
        new = np.minimum(comp, np.where(link, comp[None, :], 1 << 40).min(axis=1))
        if (new == comp).all():
            return {r[0]: (int(n), int(c)) for r, n, c in zip(rows, link.sum(axis=1), comp, strict=True)}
        comp = new


@pytest.mark.parametrize("kind, block, asking", [("float", 40, 8), ("double", 40, 1), ("float", 3, 64)])  # of blocks of 3 some have no vector
def test_vectors_of_labels_of_many_blocks_against_brute_force(spark, monkeypatch, kind, block, asking):
    monkeypatch.setattr(pq, "BLOCK_BYTES", block * 8 * 12)
    monkeypatch.setattr(pq, "ASKING", asking)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(90, 12))
    # a label of many blocks, with groups near each other and one list over several blocks; a label of two blocks; a small one
    v = [base[i % 90] + rng.normal(size=12) * rng.choice([0, 0.02, 0.05, 0.2]) for i in range(600)] + [base[7] + rng.normal(size=12) * 0.03 for _ in range(200)]
    labels = ["large"] * 500 + ["two"] * 70 + ["small"] * 30 + ["large"] * 200
    unit = np.eye(12)[1]
    v += [unit, np.where(unit == 0, -0.0, unit), 2 * unit]
    labels += ["large"] * 3
    rows = [(i, np.array(x, np.float32 if kind == "float" else float).tolist(), lab) for i, (x, lab) in enumerate(zip(v, labels, strict=True))]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in pq.near_duplicates(df.repartition(5)).collect()}
    assert got == linked(rows)


@pytest.mark.parametrize("n, strip", [(500, 16), (2000, 1024)])  # the large lists of the second are compared by products of matrices
def test_a_block_asked_in_small_steps_counts_every_link_once(monkeypatch, n, strip):
    for name, at in (("STEP", n // 8), ("STRIP", strip), ("PAIRS", 50)):
        monkeypatch.setattr(pq, name, at)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(20, 12))
    x = np.array([base[i % 20 if i % 2 else 3] + rng.normal(size=12) * rng.choice([0.01, 0.03, 0.1, 0.3]) for i in range(n)])
    x /= np.linalg.norm(x, axis=1)[:, None]
    copies, q = rng.integers(1, 4, len(x)), pq.Quantiser.fit(x, 16)
    lists, codes, error = q.encode(x)
    here = lists >= 4  # the rest stand before these and come to ask
    ids = np.arange(len(x)) + 1000
    block = pq.Block(q, x[here], ids[here], copies[here], lists[here], codes[here], error[here], 0.98)
    a, b = block.ask_itself()
    told, c, d = block.ask(x[~here], ids[~here], copies[~here], lists[~here])
    link = x @ x.T >= 0.98
    np.fill_diagonal(link, False)
    link[np.ix_(~here, ~here)] = False  # those of other blocks do not meet here
    assert dict(zip([*block.ids, *ids[~here]], [*block.n, *told], strict=True)) == dict(zip(ids, link @ copies, strict=True))
    pairs = [*zip(a, b, strict=True), *zip(c, d, strict=True)]
    assert pairs and all(link[i - 1000, j - 1000] for i, j in pairs) and len(pairs) < len(x)
    had = np.zeros_like(link)
    for i, j in pairs:
        had[i - 1000, j - 1000] = had[j - 1000, i - 1000] = True

    def least(links):
        comp = np.arange(len(x))
        while True:
            new = np.minimum(comp, np.where(links, comp[None, :], len(x)).min(axis=1))
            if (new == comp).all():
                return comp
            comp = new

    assert (least(link) == least(had)).all()


def test_a_vector_is_sent_once_for_each_block_not_for_each_list(spark, request):
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that no exchange is left out because tables are small
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.enabled"))
    rng = np.random.default_rng(4)
    n = 3000
    rows = [(i, x.tolist(), 0) for i, x in enumerate(rng.normal(size=(n, 32)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    sc = spark.sparkContext
    stages = lambda: sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)

    def written():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        all_of = stages()
        return {all_of.apply(i).stageId(): all_of.apply(i).shuffleWriteRecords() for i in range(all_of.size())}

    before = written()
    assert pq.near_duplicates(df).where("n_links = 0").count() == n
    most = max(x for k, x in written().items() if k not in before)
    assert n <= most <= 2 * n


def jaccard(x, y, size=5):
    sets = []
    for t in (x, y):
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    return len(sets[0] & sets[1]) / max(1, len(sets[0] | sets[1]))


def test_one_row_of_each_group_stays(spark):
    rng = random.Random(8)
    prose = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    a, b, c = prose(60), prose(60), prose(60)
    rows = [(3, a), (7, a), (7, b), (8, c), (8, c), (8, c + " tail"), (None, a + " end"), (None, prose(40)), (None, None), (11, None), (12, ""), (2, b + " more")]
    df = spark.createDataFrame([(*r, i, "x") for i, r in enumerate(rows)], "doc_id long, text string, component_id int, first string").repartition(3)
    got = minhash.without_duplicates(df)
    assert got.columns == df.columns
    left = [(r.doc_id, r.text) for r in got.collect()]
    assert len(left) == len(set(left)) and set(left) <= set(rows)
    # what stays is linked with nothing else that stays, and stands for what is gone
    assert all(jaccard(x, y) < 0.8 for i, (_, x) in enumerate(left) for _, y in left[:i])
    assert all(any(t == y or jaccard(t, y) >= 0.8 for _, y in left) for _, t in rows)
    assert {(3, a), (2, b + " more")} <= set(left) and sum(k is None for k, _ in left) == 2


def family(rng, n, changed=14, words=160):
    """Copies of one text, each with `changed` words of its own: by design none is like another."""
    base = [f"b{i}" for i in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for i in rng.sample(range(words), changed):
            w[i] = f"w{rng.randrange(900)}"
        out.append(" ".join(w))
    return out


def test_edited_copies_that_are_not_alike_hardly_meet(spark):
    met = {}
    for n in (60, 240):
        texts = spark.createDataFrame(list(enumerate(family(random.Random(n), n))), "id long, text string").repartition(3)
        rows = minhash.supported(minhash.compact_sets(texts, 2), 0.8).collect()
        sizes = sorted(r.size for r in rows)
        assert len(rows) == n and all(r.most >= 0 for r in rows)
        fits = [minhash.sizes_that_fit(r.size, r.most, np.array(sizes), 0.8) for r in rows]
        met[n] = sum(max(0, x.stop - x.start) for x in fits)
    assert met[240] <= 6 * max(met[60], 60)


def test_links_within_a_family_are_all_found(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng = random.Random(12)
    texts = family(rng, 90)
    for t in texts[:25]:  # near copies of some of them, and parts of others
        w = t.split()
        w[rng.randrange(len(w))] = "other"
        texts.append(" ".join(w if rng.random() < 0.5 else w[: int(len(w) * 0.85)]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, shingle=2).collect()}
    comp = list(range(len(texts)))
    for _ in range(len(texts)):
        for i in range(len(texts)):
            for j in range(i):
                if comp[i] != comp[j] and jaccard(texts[i], texts[j], 2) >= 0.8:
                    comp[i] = comp[j] = min(comp[i], comp[j])
        if all(jaccard(texts[i], texts[j], 2) < 0.8 or comp[i] == comp[j] for i in range(len(texts)) for j in range(i)):
            break
    assert got == dict(enumerate(comp)) and len(set(comp)) < len(texts)


def test_the_pipeline_judges_rows(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    prose = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    item = prose(30)
    texts = [prose(50) for _ in range(6)]
    rows = [(1, texts[0]), (1, texts[1]), (None, texts[2]), (None, texts[2]), (2, texts[0]), (4, prose(9) + " " + item), (5, None), (6, ""), (6, ""), (7, texts[3] + " call Mr Jonas Welck"), (8, "word " * 30_000)]
    schema = "doc_id long, text string, lang string, source string, n_chars int, entities string, place int"
    spark.createDataFrame([(k, t, "en", None, len(t or ""), "own", 3) for k, t in rows], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = collections.Counter((r.doc_id, r.n_tokens > 0) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    # (2, texts[0]) repeats (1, texts[0]); (4, ..) holds the item; of equal rows one stays
    assert got == collections.Counter([(1, True), (1, True), (None, True), (5, False), (6, False), (7, True), (8, True)])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.limit(0), str(tmp_path))
        assert out.columns == docs.columns and out.count() == 0, name
    masked = corpus_pipeline.replace_private(spark, docs.where("doc_id = 7"), str(tmp_path)).first()
    assert "Welck" not in masked.text and masked.entities == "own" and masked.n_chars == len(masked.text)


def test_a_worker_carries_little_from_the_encoder_to_other_stages(spark):
    import corpus_pipeline
    from panelspark.llm import bpe

    path, pattern = bpe.rank_file()
    rng = random.Random(3)
    rows = [(i, " ".join(f"{rng.getrandbits(40):x}"[:9].translate(str.maketrans("0123456789", "ghijklmnop")) for _ in range(1000))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)

    def held(batches):
        import os

        for _ in batches:
            pass
        c = bpe.codec(path, pattern) if bpe.codec.cache_info().currsize else None
        yield pa.RecordBatch.from_pydict({"pid": [os.getpid()], "pieces": [len(c.texts) if c else -1], "states": [len(c.transducer.states) if c else -1], "fits": [len(c.transducer.v._fits) if c else -1]})

    got = {r.doc_id: (r.n_tokens, r.decoded_sha256) for r in corpus_pipeline.tokenize(spark, docs, "").collect()}
    workers = spark.range(0, 64, 1, 16).mapInArrow(held, "pid long, pieces long, states long, fits long").where("pieces >= 0").collect()
    assert workers and max(r.pieces for r in workers) <= 20_000 and max(r.states for r in workers) <= 20_000 and max(r.fits for r in workers) <= 80_000
    # what was dropped is made again, with the same tokens
    whole = bpe.encode_decode(docs, path, pattern, outputs=("n_tokens", "decoded_sha256"))
    assert got == {r.doc_id: (r.n_tokens, r.decoded_sha256) for r in whole.collect()}


def test_a_lean_task_gives_memory_back_at_its_end(monkeypatch):
    from panelspark.llm import common

    said = []
    monkeypatch.setattr(common, "give_back", lambda collect=True: said.append(collect))
    batch = pa.RecordBatch.from_pydict({"n": [1]})
    out = common.lean(lambda batches: (b for b in batches))(iter([batch, batch]))
    assert next(out) == batch and not said
    assert list(out) == [batch] and said == [False]


@pytest.fixture(scope="module")
def keyless():
    rng = random.Random(5)
    prose = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    a, b, c, d = (prose(80) for _ in range(4))
    return [(1, a), (None, prose(20) + " " + a), (None, b), (None, b), (None, None), (2, c + " " + a), (2, prose(15) + " " + c), (2, d), (3, d + " " + c), (3, prose(30)), (3, prose(30))]


def test_passages_of_null_and_repeated_keys(spark, keyless):
    def gone(k, t):
        w = (t or "").split()
        out = [False] * len(w)
        for i in range(len(w) - 12):
            if any((k is None or o < k) and any(x[j : j + 13] == w[i : i + 13] for j in range(len(x) - 12)) for o, x in held):
                out[i : i + 13] = [True] * 13
        return " ".join(x for x, g in zip(w, out, strict=True) if not g)

    held = [(k, t.split()) for k, t in keyless if k is not None]
    want = collections.Counter((k, gone(k, t)) for k, t in keyless)
    got = substring.remove_repeats(spark.createDataFrame(keyless, "doc_id long, text string"), outputs=("kept",)).collect()
    assert collections.Counter((r.doc_id, r.kept) for r in got) == want and want[None, ""] == 1


def test_byte_strings_of_null_and_repeated_keys(spark, keyless):
    raw = [(k, (t or "").encode()) for k, t in keyless]
    count = collections.Counter(t[i : i + 200] for _, t in raw for i in range(len(t) - 199))
    want = collections.Counter()
    for k, t in raw:
        out = [False] * len(t)
        for i in range(len(t) - 199):
            if count[t[i : i + 200]] > 1:
                out[i : i + 200] = [True] * 200
        want[k, bytes(x for x, g in zip(t, out, strict=True) if not g)] += 1
    got = suffix.remove_repeats(spark.createDataFrame(keyless, "doc_id long, text string"), outputs=("kept",)).collect()
    assert collections.Counter((r.doc_id, bytes(r.kept)) for r in got) == want
