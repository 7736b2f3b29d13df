"""Phrases, mixing and search against brute force, with nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import collections
import math
import random
import re

import numpy as np
import pytest

from panelspark.llm import mixing, phrases, search
from panelspark.llm.transducer import Transducer, summed

GAP = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
VOCABULARY = ["Ra", "te", "mo", "é", "ko1", "漢", "of", "the", "x-y", "É"]


def corpus(seed, n=120):
    rng = random.Random(seed)

    def text(k):
        return "".join(rng.choice(VOCABULARY) + rng.choice([" "] * 9 + [". ", "\n", "\t ", ",", " ! "]) for _ in range(k))

    rows = [(i, text(rng.randint(0, 30)), rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "é", None])) for i in range(n)]
    rows += [(n, None, "en", "s1"), (n + 1, "", None, "s2"), (n + 2, " .\n", "fr", "s3"), (n + 3, text(3000), "en", "s1"), (None, text(8), "en", None), (7, text(9), "fr", "s2")]
    return rows + rows[:3]


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, source string, label string, rank int").repartition(3)


@pytest.mark.parametrize("seed", range(3))
def test_a_transducer_holds_what_it_was_built_of(seed):
    rng = np.random.default_rng(seed)
    paths = np.zeros((400, 4), np.uint64)
    for i, n in enumerate(rng.integers(1, 5, 400)):
        paths[i, :n] = rng.integers(1, 5, n)
    paths, weight = summed(paths, rng.integers(1, 4, 400))
    fst = Transducer.unpack(Transducer.build(paths, weight).pack())
    got, w = fst.paths()
    assert (got == paths).all() and (w == weight).all()
    asked = np.array([[a, b, c, d] for a in range(1, 6) for b in range(6) for c in range(6) for d in range(6)], np.uint64)
    known = {tuple(p): x for p, x in zip(paths.tolist(), weight.tolist(), strict=True)}
    whole = np.logical_and.accumulate(asked != 0, axis=1).sum(axis=1) == (asked != 0).sum(axis=1)
    assert fst.compose(asked[whole]).tolist() == [known.get(tuple(p), 0) for p in asked[whole].tolist()]
    # equal endings are stored once
    same = np.array([[a, 9, 9, 9] for a in range(1, 50)], np.uint64)
    assert len(Transducer.build(same, np.arange(1, 50)).final[1]) == 1


def expected_phrases(rows, least, top):
    f, n, score = collections.Counter(), collections.Counter(), collections.defaultdict(list)
    for _, text, lang, _ in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    cand = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    for (lang, p), a in cand.items():
        s, _, left, right = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        if not any(g == lang and len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (g, q), b in cand.items()):
            score[lang].append((-s, -a, " ".join(p).encode(), left, right))
    return {(lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, x in score.items() for i, (s, a, p, left, right) in enumerate(sorted(x)[:top], 1)}


@pytest.mark.parametrize("least, top, flush", [(30, 2000, 1 << 21), (2, 15, 500)])
def test_collocations_equal_brute_force(spark, monkeypatch, least, top, flush):
    monkeypatch.setattr(phrases, "FLUSH", flush)
    rows = corpus(5)
    got = phrases.collocations(table(spark, rows), least=least, top=top).collect()
    assert len(got) == len({(r.lang, r.rank) for r in got})
    assert {tuple(r) for r in got} == expected_phrases(rows, least, top)


def test_two_words_with_one_label_are_drawn_again(spark, monkeypatch):
    plain = phrases.labelled

    def clash(batch, seed):
        raw, start, end, label, row, joined = plain(batch, seed)
        return raw, start, end, label % np.uint64(3) + np.uint64(1) if seed == 0 else label, row, joined

    monkeypatch.setattr(phrases, "labelled", clash)
    rows = corpus(6, 40)
    assert {tuple(r) for r in phrases.collocations(table(spark, rows), least=5, top=50).collect()} == expected_phrases(rows, 5, 50)


def test_no_phrases_of_nothing(spark):
    assert phrases.collocations(table(spark, corpus(1)).limit(0)).count() == 0


def expected_targets(size):
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    free, left, out = set(order), sum(size.values()), {}
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] >= 3 * size[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = 3 * size[s]
            left -= 3 * size[s]
            free.discard(s)
    return out


@pytest.mark.parametrize("block", [4096, 16])
def test_mix_meets_its_targets(spark, block):
    rows = corpus(8)
    sized = mixing.sizes(table(spark, rows))
    plan = mixing.planned(sized)
    size = collections.Counter()
    for _, text, _, source in rows:
        size[source] += len(GAP.findall(text or ""))
    want = expected_targets(size)
    got = {r.source: r for r in plan.collect()}
    assert {s: r.source_size for s, r in got.items()} == dict(size) and all(math.isclose(got[s].target, t) for s, t in want.items())
    assert all(r.target <= 3 * r.source_size for r in got.values()) and sum(r.target for r in got.values()) == pytest.approx(sum(size.values()))
    mixed = mixing.mix(sized, plan, block).join(mixing.numbered(sized, plan).select("row", "s", "source", "size"), "row").collect()
    taken, slots, per = collections.Counter(), collections.Counter(), collections.defaultdict(set)
    for r in mixed:
        taken[r.source] += r.words
        slots[r.slot] += r.words
        per[r.slot].add(r.source)
        assert 0 < r.words <= r.size - r.start and r.epoch < 3
    assert all(taken[s] == r.want for s, r in got.items())
    assert all(len(x) == 1 for x in per.values()) and max(slots.values()) <= block
    # no word of a document twice in an epoch
    seen = collections.Counter((r.row, r.epoch, w) for r in mixed for w in range(r.start, r.start + r.words))
    assert max(seen.values()) == 1
    again = mixing.mix(sized, plan, block).collect()
    assert {(r.slot, r.row, r.epoch, r.start, r.words) for r in mixed} == {tuple(r) for r in again}


def test_every_stretch_of_the_schedule_has_the_shares(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 64)  # many groups of the running sums
    needs = {1: 700, 2: 200, 3: 0, 4: 99, 5: 1}
    got = mixing.schedule(spark.createDataFrame(list(needs.items()), "s int, slots long")).collect()
    by = collections.defaultdict(dict)
    for r in got:
        by[r.s][r["rank"]] = r.slot
    assert {s: len(x) for s, x in by.items()} == {s: n for s, n in needs.items() if n} and len({r.slot for r in got}) == 1000
    for x in by.values():
        assert sorted(x) == list(range(len(x))) and [x[i] for i in range(len(x))] == sorted(x.values())
    for upto in (64, 200, 512, 900):
        held = sorted(r.slot for r in got)[:upto]
        for s, n in needs.items():
            assert abs(sum(1 for r in got if r.s == s and r.slot <= held[-1]) - upto * n / 1000) <= 6


def test_mix_of_nothing(spark):
    sized = mixing.sizes(table(spark, corpus(1)).limit(0))
    assert mixing.mix(sized, mixing.planned(sized)).count() == 0
    wordless = mixing.sizes(table(spark, [(1, None, "en", "a"), (2, " ", "en", None)]))
    plan = mixing.planned(wordless)
    assert mixing.mix(wordless, plan).count() == 0 and [r.target for r in plan.collect()] == [0.0, 0.0]


def expected_search(rows, items, top):
    terms = [TERM.findall((t or "").translate(LOWER)) for _, t, *_ in rows]
    n, total = sum(map(bool, terms)), sum(map(len, terms))
    tf = [collections.Counter(t) for t in terms]
    df = collections.Counter(x for t in tf for x in t)
    asked = collections.defaultdict(set)
    for item, text in items:
        asked[item] |= set(TERM.findall((text or "").translate(LOWER)))
    out = set()
    for item, own in asked.items():
        scores = []
        for (doc, *_), t, c in zip(rows, terms, tf, strict=True):
            m = 10 + 90 * len(t) * n // total
            s = sum(int(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (1000000000 * c[x] // (1000 * c[x] + 8 * m)) for x in own if c[x])
            if s > 0:
                scores.append((-s, doc is None, doc or 0))
        out |= {(item, i, None if null else doc, -s) for i, (s, null, doc) in enumerate(sorted(scores)[:top], 1)}
    return out


@pytest.mark.parametrize("docs_a_block, items_a_bundle, owners", [(4096, 512, search.OWNERS), (8, 2, (2600, 900, 700)), (8, 512, ())])
def test_search_equals_brute_force(spark, monkeypatch, docs_a_block, items_a_bundle, owners):
    monkeypatch.setattr(search, "BLOCK_DOCS", docs_a_block)
    monkeypatch.setattr(search, "BUNDLE_ITEMS", items_a_bundle)
    monkeypatch.setattr(search, "OWNERS", owners)
    rng = random.Random(3)
    rows = corpus(9, 300) + [(1000 + i, f"rare{i % 7} Ra te" + " mo" * (i % 3), "en", "s") for i in range(60)]
    items = [(i, " ".join(rng.choice(VOCABULARY) for _ in range(4)) + f" RARE{i} rare{i + 1}") for i in range(9)]
    items += [(50, None), (51, "nowhere"), (52, "the of the"), (None, "ko1"), (3, "also rare6"), (53, "!?")]
    table_of_items = spark.createDataFrame([(*i, "x") for i in items], "item_id int, text string, term string")
    got = search.search(table(spark, rows), table_of_items).collect()
    assert {tuple(r) for r in got} == expected_search(rows, items, 10)
    assert len({(r.item_id, r["rank"]) for r in got}) == len(got)


def test_search_without_documents_or_items(spark):
    items = spark.createDataFrame([(1, "ra")], "item_id int, text string")
    assert search.search(table(spark, corpus(1)).limit(0), items).count() == 0
    assert search.search(table(spark, corpus(1, 9)), items.limit(0)).count() == 0
