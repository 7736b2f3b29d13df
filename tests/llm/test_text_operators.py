"""Text operators against brute force on small tables, with nulls, empty and long texts, ties, repeats and extra columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from panelspark.llm import bpe, decontam, langid, minhash, pii, pq, sharding, substring, suffix, toxicity
from panelspark.llm.common import steps, text_bytes

WORDS = [f"{a}{b}" for a in ("ra", "te", "mo", "li", "su", "né", "ko") for b in ("n", "st", "ve", "ß", "ou", "p")]
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng, text, k):
    w = text.split(" ")
    for _ in range(k):
        w[rng.randrange(len(w))] = rng.choice(WORDS) + "x"
    return " ".join(w)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    base = [prose(rng, rng.randint(1, 120)) for _ in range(60)]
    out = [*base, None, "", "  \n\t ", "one", "one", "word " * 400, prose(rng, 6000)]
    for b in base[:20]:
        out += [b, edited(rng, b, 1), edited(rng, b, 3), prose(rng, 9) + " " + b + "\n" + prose(rng, 5)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "a", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, shard string, n_chars int")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def test_bpe_equals_tiktoken_and_round_trips(spark, docs, texts):
    import base64

    import public_tokenizers as P
    import tiktoken

    path, pattern = bpe.rank_file()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    odd = ["漢字🙂 ‮ ½ ² Ⅷ", "a" * 400, "I'LL don't  \n\n x", " lead", "trail ", "\x00\x01", "aab" * 300]
    more = docs.select("doc_id", "text").unionAll(spark.createDataFrame(list(enumerate(odd, 10_000)), "doc_id long, text string"))
    want = dict(enumerate(texts)) | dict(enumerate(odd, 10_000))
    for r in bpe.encode_decode(more, path, pattern, outputs=("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256")).collect():
        t = want[r.doc_id] or ""
        ids = enc.encode_ordinary(t)
        assert (r.ids, r.n_tokens, r.decoded) == (ids, len(ids), t)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert bpe.encode_decode(empty(spark), path, pattern).count() == 0
    with pytest.raises(ValueError):
        bpe.encode_decode(docs, path, pattern, outputs=("nothing",))


def test_bpe_reads_new_pieces_side_by_side(monkeypatch):
    import base64

    import public_tokenizers as P
    import tiktoken

    path, pattern = bpe.rank_file()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    new = ["".join(rng.choice("etaoinéß") for _ in range(rng.randint(2, 14))) + rng.choice(["", "", ".", "!?", ",x", "'s"]) for _ in range(4000)]
    texts = [" ".join(new[i : i + 50]) for i in range(0, 4000, 50)]
    c, alone, found = bpe.Codec(path, pattern), [], []
    encode, find = c.transducer.encode, c.find
    monkeypatch.setattr(c.transducer, "encode", lambda p: alone.append(p) or encode(p))
    monkeypatch.setattr(c, "find", lambda t: found.append(t) or find(t))
    for t, (ids, joined) in zip(texts, c.encode(texts), strict=True):
        assert ids.tolist() == enc.encode_ordinary(t) and joined == ",".join(map(str, ids.tolist()))
    # no piece by itself; of the parts only those that begin a text
    assert not alone and len(found) <= len(texts) + 1
    # few states and narrow blocks, long pieces, white space at borders, nothing known and everything known
    monkeypatch.setattr(bpe, "MAX_STATES", 50)
    monkeypatch.setattr(bpe, "BLOCK", 40)
    texts = ["", " ", "a \x1c b", "x\n y", "end ", "end \n", "ab" * 300 + " " + "é" * 90 + " é", "🙂" * 70 + "!", *texts[:6]]
    c.forget()
    for _ in range(2):
        assert [ids.tolist() for ids, _ in c.encode(texts)] == [enc.encode_ordinary(t) for t in texts]
        assert max(map(len, c.known)) <= bpe.LONG_PIECE
    assert alone  # those of more than LONG_BYTES
    # a pattern that leaves something out
    c = bpe.Codec(path, "[a-z]+")
    assert [ids.tolist() for ids, _ in c.encode(["ab1 tion!the 12 the", "12"])] == [[i for p in ("ab", "tion", "the", "the") for i in enc.encode_ordinary(p)], []]


@pytest.mark.parametrize("seed", range(4))
def test_utf8_machine_equals_python(seed):
    import codecs

    rng = random.Random(seed)
    raw = bytes(rng.choice([0x41, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x99, 0x82, 0xFF, 0x80]) for _ in range(400))
    m, ref, got, want = bpe.Utf8Machine(), codecs.getincrementaldecoder("utf-8")("replace"), "", ""
    for i in range(0, len(raw), 3):
        got += m.feed(raw[i : i + 3])
        want += ref.decode(raw[i : i + 3])
    assert got + m.end() == want + ref.decode(b"", True)


def test_passages_against_brute_force(spark, docs, texts):
    first, words = {}, {}
    for i, t in enumerate(texts):
        w = words[i] = SPACE.findall(t or "")
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    hits = 0
    for r in substring.remove_repeats(docs, outputs=("n_words", "n_removed", "kept", "kept_sha256")).collect():
        w = words[r.doc_id]
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < r.doc_id:
                gone[k : k + 13] = [True] * 13
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        hits += sum(gone)
        assert (r.n_words, r.n_removed, r.kept) == (len(w), sum(gone), kept) and r.kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()
    assert hits > 500
    assert substring.remove_repeats(empty(spark)).count() == 0


def test_byte_strings_against_brute_force(spark, docs, texts):
    raw = {i: (t or "").encode() for i, t in enumerate(texts)}
    count = collections.Counter(b[k : k + 200] for b in raw.values() for k in range(len(b) - 199))
    hits = 0
    for r in suffix.remove_repeats(docs).collect():
        b = raw[r.doc_id]
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            if count[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        spans = int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum())
        hits += int(gone.sum())
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(b), int(gone.sum()), spans) and bytes(r.kept) == np.frombuffer(b, np.uint8)[~gone].tobytes()
    assert hits > 1000
    assert suffix.remove_repeats(empty(spark)).count() == 0


@pytest.mark.parametrize("reach", [256, 4])
def test_suffix_array_and_prefixes(monkeypatch, reach):
    monkeypatch.setattr(suffix, "REACH", reach)
    rng = random.Random(3)
    for n in (1, 2, 7, 60, 400):
        for letters in (1, 2, 4):
            t = [rng.randrange(1, letters + 1) for _ in range(n)] + [0]
            want = sorted(range(len(t)), key=lambda i: t[i:])
            order = suffix.suffix_array(np.array(t), letters + 2)
            assert order.tolist() == want
            lcp = suffix.permuted_prefixes(np.array(t), order)
            for a, b in zip(want, want[1:], strict=False):
                k = 0
                while max(a, b) + k < len(t) and t[a + k] == t[b + k]:
                    k += 1
                assert lcp[b] == k


def test_fm_index_matching_statistics():
    rng = random.Random(8)
    seqs = [np.array([rng.randrange(1, 5) for _ in range(rng.randint(5, 60))]) for _ in range(12)]
    index = substring.FmIndex(np.concatenate([x for s in seqs for x in (s, np.zeros(1, np.int64))]), 6)
    queries = [*seqs[:3], np.array([rng.randrange(1, 6) for _ in range(80)])]
    have = {tuple(s[i:j]) for s in seqs for i in range(len(s)) for j in range(i + 1, min(len(s), i + 6) + 1)}
    for text, place, length, _ in index.matching_statistics(queries):
        for t, p, n in zip(text, place, length, strict=True):
            q = queries[t]
            want = max((k for k in range(1, 7) if p + k <= len(q) and tuple(q[p : p + k]) in have), default=0)
            assert n == want


def test_minhash_against_brute_force(spark, docs, texts):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in enumerate(texts):
        w = SPACE.findall((t or "").translate(low))
        sets[i] = set(zip(w, w[1:], strict=False)) if len(w) > 1 else ({tuple(w)} if w else set())
    top = list(range(len(texts)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in sets:
        for j in range(i):
            k = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * k >= 80 * (len(sets[i]) + len(sets[j]) - k):
                a, b = sorted((find(i), find(j)))
                top[b] = a
    for r in minhash.near_duplicates(docs, shingle=2).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), find(r.doc_id), find(r.doc_id) == r.doc_id)
    assert minhash.near_duplicates(empty(spark)).count() == 0


def test_blocks_find_what_centres_miss(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    rng = random.Random(2)
    chain = [prose(rng, 200)]
    for _ in range(25):
        chain.append(edited(rng, chain[-1], 6))
    df = spark.createDataFrame(list(enumerate(chain)), "doc_id long, text string")
    assert {r.component_id for r in minhash.near_duplicates(df, shingle=2).collect()} == {0}


def components_by_hand(texts):
    """(set, smallest row reachable) of each text, two-word shingles."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for t in texts:
        w = SPACE.findall((t or "").translate(low))
        sets.append(set(zip(w, w[1:], strict=False)) if len(w) > 1 else ({tuple(w)} if w else set()))
    top = list(range(len(texts)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * k >= 80 * (len(sets[i]) + len(sets[j]) - k):
                a, b = sorted((find(i), find(j)))
                top[b] = a
    return sets, [find(i) for i in range(len(sets))]


def test_one_large_family_repeated_and_null_keys(spark, monkeypatch):
    """A family whose members lie at, under and over the threshold from each other, in many blocks; keys that repeat or are null."""
    monkeypatch.setattr(minhash, "BLOCK", 64)
    rng = random.Random(12)
    base = prose(rng, 150)
    texts = [base, *(edited(rng, base, rng.choice([2, 6, 9, 11, 14])) for _ in range(700)), *(prose(rng, 40) for _ in range(50)), "one two three four", "five six seven eight", None, base]
    keys = list(range(len(texts)))
    keys[-4] = keys[-3] = 7_000  # two texts under one key
    keys[400] = keys[720] = None
    df = spark.createDataFrame(list(zip(keys, texts, strict=True)), "doc_id long, text string")
    sets, comp = components_by_hand(texts)
    least = {}
    for k, c in zip(keys, comp, strict=True):
        if k is not None:
            least[c] = min(k, least.get(c, k))
    want = collections.Counter((k, len(s), least.get(c), k == least.get(c) if k is not None else least.get(c) is None) for k, s, c in zip(keys, sets, comp, strict=True))
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, shingle=2).collect())
    assert got == want and len({c for c in comp}) > 60


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(30, 16))
    rows = [(i, base[i % 30] + rng.normal(size=16) * rng.choice([0, 0.02, 0.05, 0.2]), i % 2) for i in range(300)]
    rows = [(i, v.astype(float).tolist(), lab) for i, v, lab in rows]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, rows[0][1], None), (904, [1.0], 0), (905, [None] * 16, 0)]
    got = {r.vec_id: r for r in pq.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert len(got) == len(rows)
    x = np.array([r[1] for r in rows[:300]])
    x /= np.linalg.norm(x, axis=1)[:, None]
    lab = np.array([r[2] for r in rows[:300]])
    link = (x @ x.T >= 0.98) & (lab[:, None] == lab[None, :])
    np.fill_diagonal(link, False)
    comp = np.arange(300)
    for _ in range(300):
        new = np.minimum(comp, np.where(link, comp[None, :], 999).min(axis=1))
        if (new == comp).all():
            break
        comp = new
    for i in range(300):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (int(link[i].sum()), int(comp[i]), bool(comp[i] == i))
    assert all(got[i].n_links == 0 and got[i].kept for i in range(900, 906))


def test_probes_of_the_earlier_list_find_every_pair():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 8))
    x[200:] = x[:200] + rng.normal(size=(200, 8)) * 0.06
    x /= np.linalg.norm(x, axis=1)[:, None]
    q = pq.Quantiser.fit(x, 24)
    lists, probes = q.encode(x)[0], set(zip(*map(list, q.probes(x, 0.2)), strict=True))
    near = [(i, j) for i in range(400) for j in range(i) if np.linalg.norm(x[i] - x[j]) <= 0.2]
    assert any(lists[i] != lists[j] for i, j in near)
    for i, j in near:
        i, j = (i, j) if lists[i] <= lists[j] else (j, i)
        assert (i, lists[j]) in probes
    assert all(to >= lists[i] for i, to in probes)


def test_decontamination_finds_near_items_and_leaves_the_rest(spark):
    rng = random.Random(6)
    items = [prose(rng, n) for n in (15, 30, 59, 3)] + [None, ""]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = [prose(rng, 80) + " " + ",  ".join(w.capitalize() for w in items[1].split()) + " " + prose(rng, 40), prose(rng, 30) + " " + edited(rng, items[2], 1), items[0], prose(rng, 300), None, "", prose(rng, 5) + " " + items[3] + "."]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(rows)], "doc_id long, text string, similarity int")
    got = {(r.doc_id, r.item_id): r for r in decontam.contaminated(df, bench).collect()}
    assert {(0, 1), (1, 2), (2, 0), (6, 3)} <= set(got) and {k[0] for k in got if k[1] != 3} == {0, 1, 2}
    assert got[0, 1].similarity == 1.0 and got[0, 1].start_word == 80 and 0.8 <= got[1, 2].similarity < 1
    assert {r.doc_id for r in decontam.clean(df, bench).collect()} >= {3, 4, 5}
    blocks = list(decontam.indexes(bench, limit=200))
    assert len(blocks) > 1 and sum(len(v[1]) for b in blocks for v in b.sizes.values()) == 4
    one = decontam.Index([(i, t) for i, t in enumerate(items) if t])
    assert {w: len(v[1]) for w, v in one.sizes.items()} == {3: 1, 15: 1, 30: 1, 59: 1}


def test_decontamination_against_brute_force(spark):
    """Every window of an item's size in every document, with windows on both sides of the threshold, repeated and null item ids."""
    rng = random.Random(31)
    items = [(i % 40, prose(rng, rng.choice([20, 48, 50, 61]))) for i in range(120)] + [(None, prose(rng, 50)), (500, prose(rng, 300))]
    rows = []
    for i in range(160):
        _, t = items[i % len(items)]
        rows.append(prose(rng, rng.randint(0, 30)) + " " + edited(rng, t, rng.choice([0, 1, 1, 2, 3])) + " " + prose(rng, rng.randint(0, 30)))

    def bag(words):
        return collections.Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))

    want = set()
    for d, t in enumerate(rows):
        w = t.split()
        for item, text in items:
            own = bag(text.split())
            n = len(text.split())
            for k in range(len(w) - n + 1):
                shared = (bag(w[k : k + n]) & own).total()
                if shared / (2 * own.total() - shared) >= 0.8:
                    want.add((d, item))
                    break
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got <= want and len(got) >= 0.99 * len(want) and len(want) > 60 and any(i is None for _, i in got)
    assert decontam.contaminated(empty(spark), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert decontam.contaminated(docs, empty(spark).withColumnRenamed("doc_id", "item_id")).count() == 0


def test_toxicity_learns_folds_and_spares(spark):
    rng = random.Random(9)
    bad = ["grubzot", "flanwick", "snorpel"]
    texts, labels = [], []
    for i in range(400):
        t = prose(rng, 60).split()
        if i % 4 == 0:
            t[rng.randrange(60)] = rng.choice(bad)
            t[rng.randrange(60)] = rng.choice(bad)
        texts.append(" ".join(t))
        labels.append(int(any(b in texts[-1] for b in bad)))
    lex = toxicity.learn(texts, labels)
    rows = [(0, "raou gRubz0t moп flаnwick, teste", 5), (1, prose(rng, 50), 5), (2, None, 5), (3, "", 5), (4, "grubzot " * 3, 5)]
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string, score int").select("doc_id", "text"), lex).collect()}
    assert got[0].predicted == 1 and got[4].predicted == 1 and got[1].predicted == got[2].predicted == got[3].predicted == 0
    lex.exceptions.append("nice grubzot")
    m = lex.matches(lex.automaton(), " a nice grubzot here ")
    assert not m and toxicity.learn(["a"], [0]).score(0, 1) == 0.0
    assert not toxicity.learn(["a b", "a b", "c"], [0, 1, 0]).terms  # labels of both kinds, but no term that tells


def test_language_of_words_in_switched_text(spark):
    rng = random.Random(4)
    kinds = {"aa": ["lorath", "venith", "quorath", "dath"], "bb": ["muelo", "riselo", "panelo", "telo"], "cc": ["éspiv", "ébriv", "éclav", "éniv"]}
    rows = [(" ".join(rng.choice(v) + rng.choice(["", "a", "i"]) for _ in range(30)), k) for k, v in kinds.items() for _ in range(40)]
    field = langid.fit([t for t, _ in rows], [k for _, k in rows], rounds=40)
    mixed = "lorath dath venitha quorath muelo riselo telo paneloi éspiv ébriv éniva"
    raw, off = text_bytes(pa.array([mixed, "", mixed], pa.large_string()))
    start, _, first, p = langid.label_words(field, raw, off)
    want = ["aa"] * 4 + ["bb"] * 4 + ["cc"] * 3
    assert [field.labels[i] for i in p[: first[1]].argmax(axis=1)] == want and np.allclose(p[: first[1]], p[first[2] :])
    docs = spark.createDataFrame([(0, mixed), (1, None), (2, ""), (3, "123 ... 4"), (4, "漢字"), (5, "lorath " * 3000)], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, field).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[5][0] == "aa" and all(0 <= s <= 1 for _, s in got.values())


def test_forward_backward_in_blocks_equals_the_plain_recursion():
    rng = np.random.default_rng(0)
    tr, first = rng.normal(size=(3, 3)), np.array([0, 1, 1, 200, 233])
    sc = rng.normal(size=(233, 3))
    got = langid.marginals(sc, first, tr)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b > a:
            x, t = np.exp(sc[a:b]), np.exp(tr)
            f, bw = [(np.full(3, 1 / 3) @ t) * x[0]], [np.ones(3)]
            for i in range(1, b - a):
                f.append((f[-1] / f[-1].sum() @ t) * x[i])
                bw.append(t @ (x[b - a - i] * bw[-1]))
                bw[-1] /= bw[-1].sum()
            p = np.array(f) * np.array(bw[::-1])
            assert np.allclose(got[a:b], p / p.sum(axis=1, keepdims=True))


def test_shards_are_even_gapless_and_versioned(spark, docs, texts):
    dealt, table = sharding.shard(docs, 5, slots=512)
    rows = dealt.collect()
    assert len(rows) == len(texts)
    by = collections.defaultdict(list)
    for r in rows:
        t = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(t) + 16, zlib.crc32(t))
        by[r.shard].append((r.slot, r.size))
    assert all(sorted(s for s, _ in v) == list(range(len(v))) for v in by.values())
    big = max(r.size for r in rows)
    loads = [sum(s for _, s in v) for v in by.values()]
    assert max(loads) - min(loads) <= big
    moved = table.groupBy("vslot").agg({"shard": "min", "version": "max"}).count()
    assert moved == 512 and table.select("version").distinct().count() == 2
    assert sharding.shard(empty(spark), 5)[0].count() == 0


def test_rebalancing_edits_the_stored_map(spark, docs, tmp_path):
    path = str(tmp_path / "map")
    sharding.save_map(sharding.shard(docs, 5, slots=512)[1], path)
    more = docs.select("doc_id", "text").unionAll(docs.where("doc_id % 3 = 0").selectExpr("doc_id + 10000", "concat(text, ' more')"))
    dealt, table = sharding.shard(more, 6, slots=512, current=sharding.load_map(spark, path))
    sharding.save_map(table, path)
    stored = sharding.load_map(spark, path)
    by = {v: {r.vslot: r.shard for r in stored.where(f"version = {v}").collect()} for v in (0, 1, 2)}
    assert stored.count() == 3 * 512 and all(len(m) == 512 for m in by.values())
    moved = [s for s in range(512) if by[1][s] != by[2][s]]
    rows = dealt.collect()
    held = {r.vslot for r in rows}
    loads = collections.Counter()
    for r in rows:
        loads[r.shard] += r.size
        assert r.version == 2 and r.shard == by[2][r.vslot]
    assert 0 < len(moved) <= len(held) / 3 and set(moved) <= held
    assert len(loads) == 6 and max(loads.values()) - min(loads.values()) <= max(r.size for r in rows)
    with pytest.raises(ValueError):
        sharding.shard(docs, 5, slots=256, current=stored)


def test_no_labelled_row_is_no_language(spark, docs):
    field = langid.train(docs.withColumn("lang", docs["id"]).where("doc_id < 0"))
    got = {(r.lang_pred, r.score) for r in langid.identify(docs, field).collect()}
    assert got == {("und", 0.0)} and langid.identify(empty(spark), field).count() == 0


def test_surrogates_keep_format_and_identity(spark):
    text = "Mail Bob.Smith@Mail.example.com, bob.smith@mail.example.com; +1 (386) 555-3733, 10.0.0.1. 4041894974608795 4041-8949-7460-8795 1234567812345678 token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" Mrs. Jane Doe and Г-жа Анна Иванова"
    rows = [(0, text, "x"), (1, None, "x"), (2, "", "x"), (3, "plain 12 words.", "x"), (4, text, "y")]
    got = {r.doc_id: r for r in pii.replace(spark.createDataFrame(rows, "doc_id long, text string, source string"), key="k").collect()}
    assert got[1].text is None and got[2].text == "" and got[3].text == rows[3][1] and got[0].text == got[4].text and got[0].source == "x"
    out = got[0].text
    for secret in ("ob.Smith", "555-3733", "10.0.0.1", "4041894974608795", "04dbebab", "Jane", "Анна"):
        assert secret not in out
    assert "1234567812345678" in out  # no valid card number
    e = [(x.kind, x.surrogate) for x in got[0].entities]
    assert e[0][1].lower() == e[1][1] and e[4][1] == e[5][1].replace("-", "") and e[4][1][0] == "4"
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", e[2][1])
    assert e[7][1].startswith("Mrs. ") and e[7][1].split(" ")[1] in pii.NAMES["f", "latin"] and e[8][1].split(" ")[1] in pii.NAMES["f", "cyrillic"]
    with pytest.raises(ValueError):
        pii.replace(spark.createDataFrame([(1, "a", 1)], "doc_id long, text string, entities int"))


def test_collisions_get_another_attempt(spark, monkeypatch):
    monkeypatch.setattr(pii, "DIGITS", "01")
    ents = spark.createDataFrame([("ssn", f"{i:09b}", "m") for i in range(40)], "kind string, canon string, gender string")
    late = {(r.canon): r.attempt for r in pii.attempts(ents, "k").collect()}
    from pyspark.sql import functions as F

    m = ents.join(spark.createDataFrame(list(late.items()) or [("-", 0)], "canon string, attempt int"), "canon", "left")
    subs = [r[0] for r in m.select(pii.surrogate("k", F.col("kind"), F.col("canon"), F.coalesce("attempt", F.lit(0)), F.col("gender"))).collect()]
    assert len(set(subs)) == 40 and not set(subs) & {f"{i:09b}" for i in range(40)}


def test_more_names_than_the_first_attempt_holds(spark, monkeypatch):
    monkeypatch.setattr(pii, "SYLLABLES", {"latin": ("ba", "de", "go", "ki"), "cyrillic": ("ба", "де", "го", "ки")})
    from pyspark.sql import functions as F

    names = [f"surname{i}" for i in range(1500)]  # the first attempt has 512 names
    ents = spark.createDataFrame([("person", n, g) for n in names for g in "mf"], "kind string, canon string, gender string")
    late = pii.attempts(ents, "k").withColumnRenamed("entity_gender", "gender")
    m = ents.join(late, ["kind", "canon", "gender"], "left").select(pii.surrogate("k", F.col("kind"), F.col("canon"), F.coalesce("attempt", F.lit(0)), F.col("gender")))
    assert len({r[0] for r in m.collect()}) == 3000


def test_surrogates_of_persons_and_rows_without_keys(spark):
    rows = [(None, "Mr Kim Lee met Mrs Kim Lee. Mr. Kim Lee left."), (1, "Mr Kim Lee 10.1.2.3"), (1, "nothing 10.1.2.3 there"), (None, None)]
    out = pii.replace(spark.createDataFrame(rows, "doc_id long, text string"), key="k")
    got = collections.defaultdict(list)
    for r in out.collect():
        got[r.doc_id].append(r)
    (a, b), (c, d) = sorted(got[None], key=lambda r: r.text is None), sorted(got[1], key=lambda r: -len(r.entities))
    he, she, again = (e.surrogate for e in a.entities)
    assert he != she and he.split(" ", 1)[1] == again.split(" ", 1)[1] == c.entities[0].surrogate.split(" ", 1)[1] != she.split(" ", 1)[1]
    assert b.text is None and b.entities is None and c.entities[1].surrogate == d.entities[0].surrogate and d.text == f"nothing {d.entities[0].surrogate} there"
    assert pii.replace(empty(spark)).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as C

    src = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{src}/documents.parquet")
    out = C.run(spark, src).collect()
    assert 0 < len(out) < docs.count() and all(r.n_tokens == len(r.ids) for r in out)
    assert [n for n, _ in C.STAGES] == ["toxicity", "minhash_near_dedup", "benchmark_decontamination", "pii_surrogates", "byte_bpe"]
    for _, stage in C.STAGES[1:4]:
        assert stage(spark, docs.limit(0), src).columns == docs.columns


def test_long_texts_are_steps_of_their_own():
    b = pa.record_batch({"text": pa.array(["a" * (3 << 20), "b", None, "c"])})
    assert [len(s) for s in steps(iter([b]))] == [1, 3]

