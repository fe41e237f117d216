"""Near-duplicates, personal information and truncation: against brute force, planted cases, and edge cases."""

from __future__ import annotations

import random
import re
import time
from itertools import combinations

import numpy as np
import pytest

from chronolith.llm import blocks as bl
from chronolith.llm import neardup as nd
from chronolith.llm import pii
from chronolith.llm import setsketch as sk
from chronolith.llm import truncation as tr

WORDS = [f"w{k}" for k in range(400)]


def shingles(text, k):
    w = re.findall("[a-z0-9]+", text.lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def corpus(rng, n):
    texts = []
    for _ in range(n):
        base = [rng.choice(WORDS) for _ in range(rng.randrange(20, 60))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(3)):
            other = list(base)
            for _ in range(rng.randrange(1, 8)):
                other[rng.randrange(len(other))] = rng.choice(WORDS)
            texts.append(" ".join(other))
    return texts + texts[:5]


@pytest.mark.parametrize(("words", "threshold"), [(3, 0.5), (5, 0.8)])
def test_near_duplicates_equal_brute_force(spark, words, threshold):
    texts = corpus(random.Random(5), 120)
    rows = [(f"k{i:04}", t, "x") for i, t in enumerate(texts)] + [("n", None, "x"), ("e", "", "x"), ("s", "too short", "x"), ("u", "日本語 " * 30, "x"), ("long", "a b " * 100_000, "x")]
    df = spark.createDataFrame(rows, "key string, text string, class string")
    members, links = nd.near_duplicates(df.repartition(3), "key", "text", words, threshold, min_words=20)
    got = {(r.key_a, r.key_b) for r in nd.expand(members, links, "key").collect()}
    sets = {k: shingles(t, words) for k, t, _ in rows if t and len(re.findall("[a-z0-9]+", t.lower())) >= 20}
    keys = sorted(sets)
    want = {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}
    assert got <= want
    assert len(got) >= 0.99 * len(want) and want


@pytest.mark.parametrize("hot_band", [4, 40])
def test_common_bands_lose_nothing(spark, hot_band):
    """A third of all rows shares a passage; bands and shingles of many rows are worked off part by part."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(4000)}"
    passage = [f"common{k}" for k in range(40)]
    texts = [" ".join(passage + [word() for _ in range(rng.choice([3, 12, 30]))]) for _ in range(100)]
    texts += [" ".join(word() for _ in range(40)) for _ in range(150)] + texts[:5]
    rows = [(f"k{i:04}", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "key string, text string").repartition(4)
    members, links = nd.near_duplicates(df, "key", "text", 3, 0.5, 20, hot_band)
    got = {(r.key_a, r.key_b) for r in nd.expand(members, links, "key").collect()}
    sets = {k: shingles(t, 3) for k, t in rows}
    want = {(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b])}
    assert got <= want and len(got) >= (1.0 if hot_band == 4 else 0.99) * len(want) and len(want) > 500


def test_texts_of_the_same_phrases_are_no_candidates(spark, monkeypatch):
    """Chance candidates grow with the square of the table: they may not leave the bands, whatever the groups and parts."""
    rng = random.Random(3)
    phrases = [" ".join(f"p{k}x{j}" for j in range(6)) for k in range(6)]
    texts = [" ".join(w for k in rng.sample(range(6), 3) for w in (phrases[k], *(rng.choice(WORDS) for _ in range(9)))) for _ in range(700)]
    texts += [t.replace("w1 ", "w2 ") + " end" for t in texts[:20]]
    df = spark.createDataFrame([(f"k{i:04}", t) for i, t in enumerate(texts)], "key string, text string").repartition(4)
    sets = {f"k{i:04}": shingles(t, 3) for i, t in enumerate(texts)}
    want = {(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b])}
    moved = []
    candidates = nd._candidates
    monkeypatch.setattr(nd, "_candidates", lambda *x: moved.append(nd.cut(candidates(*x))) or moved[-1])
    for few, part in ((50_000, 4_000), (10, 4_000), (10, 5)):
        monkeypatch.setattr(nd, "FEW", few)
        monkeypatch.setattr(nd, "BAND_PART", part)
        members, links = nd.near_duplicates(df, "key", "text", 3, 0.5, 20)
        assert {(r.key_a, r.key_b) for r in nd.expand(members, links, "key").collect()} == want and len(want) >= 20
        assert moved[-1].count() <= len(want) + 20


def test_classes_are_named_by_their_smallest_key(spark):
    base = [f"w{k}" for k in range(60)]
    texts = {"d": base, "b": base, "c": [*base, "end"], "a": [f"x{k}" for k in range(30)]}
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in texts.items()] + [("b", " ".join(base))], "key string, text string")
    members, pairs = nd.named_classes(*nd.near_duplicates(df, "key", "text"), "key")
    assert {tuple(r) for r in members.select("key", "class", "copies", "links").collect()} == {("a", "a", 1, 0), ("b", "b", 2, 1), ("d", "b", 2, 1), ("c", "c", 1, 1)}
    assert [(r.class_a, r.class_b, round(r.similarity, 6)) for r in pairs.collect()] == [("b", "c", round(56 / 57, 6))]


def test_sketches_and_shingles_are_never_broadcast(spark, tmp_path):
    df = spark.createDataFrame([(f"k{i:04}", t) for i, t in enumerate(corpus(random.Random(5), 60))], "key string, text string")
    members, links = nd.near_duplicates(df, "key", "text")
    for result in (links, nd.expand(members, links, "key")):
        plan = result._jdf.queryExecution().executedPlan().toString()
        wide = [line for line in plan.splitlines() if "Broadcast" in line and ("shingles" in line or "registers" in line)]
        assert "SortMergeJoin" in plan and not wide


@pytest.mark.parametrize(("count", "part"), [(50, 7), (400, 320), (3, 1000)])
def test_every_pair_of_a_block_once(spark, count, part):
    index = spark.createDataFrame([(k, "x" if k % 10 else "y", 2 * k) for k in range(count)], "id long, block string, n long")
    large = bl.large_blocks(index, "block", "id", part)
    got = [(r.a, r.b, r.n_a, r.n_b) for r in bl.block_pairs(index, "block", "id", large, ("n",)).collect()]
    want = {(a, b, 2 * a, 2 * b) for a, b in combinations(range(count), 2) if (a % 10 == 0) == (b % 10 == 0)}
    assert len(got) == len(set(got)) and set(got) == want
    other = index.toDF("other", "block", "m")
    met = bl.cells(index, other, "block", large, "id", "other")
    assert met.count() == 2 * len(want) + count


def test_no_texts(spark):
    df = spark.createDataFrame([], "key string, text string")
    members, links = nd.near_duplicates(df, "key", "text")
    assert (members.count(), links.count()) == (0, 0)


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(6)
    a = rng.integers(0, 2**62, 900)
    sets = [a[:600], a[300:], a]
    flat, offsets = np.concatenate(sets), np.r_[0, np.cumsum([len(s) for s in sets])]
    r = sk.sketch(flat, offsets)
    assert (sk.merge(r[:1], r[1:2]) == r[2:]).all()
    assert abs(sk.jaccard(r[:1], r[1:2], np.array([600]), np.array([600]))[0] - 1 / 3) < 0.12
    assert sk.jaccard(r[:1], r[:1], np.array([600]), np.array([600]))[0] == 1.0


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_banding_bound(threshold):
    rows, bands = sk.bands_for(threshold)
    assert rows * bands <= sk.REGISTERS and (1 - threshold**rows) ** bands <= 0.003


FOUND = [
    ("Mail ann.lee+git@corp.example, please", [("email", "ann.lee+git@corp.example")]),
    ("mail mailto:ANN@CORP.EXAMPLE.", [("email", "ANN@CORP.EXAMPLE")]),
    ("ask ann (at) corp (dot) example twice", [("email", "ann (at) corp (dot) example")]),
    ("ask a dot lee at corp dot example twice", [("email", "a dot lee at corp dot example")]),
    ("use аnn@corp.example now", [("email", "аnn@corp.example")]),  # Cyrillic a
    ("call ０３０/23125910 now", [("phone", "０３０/23125910")]),
    ("call +44 1632 960117 or (404) 555-0114", [("phone", "+44 1632 960117"), ("phone", "(404) 555-0114")]),
    ("tel. zero one six three two nine six zero one one seven", [("phone", "zero one six three two nine six zero one one seven")]),
    ("SSN 942-55-6334, NI number QQ 12 34 56 C", [("id_number", "942-55-6334"), ("id_number", "QQ 12 34 56 C")]),
    ("passport X97400034 in logs", [("id_number", "X97400034")]),
    ("to PO Box 367, Merstow ZX6; see", [("address", "PO Box 367, Merstow ZX6")]),
    ("at 10032 N Hulom Ave Apt 3B, Fenmouth, ZZ 00579 twice", [("address", "10032 N Hulom Ave Apt 3B, Fenmouth, ZZ 00579")]),
    ("on 88 bis rue du Branav, 00924 Mermouth.", [("address", "88 bis rue du Branav, 00924 Mermouth")]),
    ("Reviewed-by: Łucja B. Gälav <l@x.example>", [("name", "Łucja B. Gälav"), ("email", "l@x.example")]),
    ("As noted by Lee, Ann, the slab", [("name", "Lee, Ann")]),
    ("Thanks to Dr. Ann Lee for it", [("name", "Ann Lee")]),
    ("Spotted by P. Lee during", [("name", "P. Lee")]),
    ("Thanks to the Platform Build Team.", []),
    ("Reported-by: fuzz-bot <noreply@bots.example.org>", []),
    ("git@git.example.org:a/b.git and announce@lists.example.org", []),
    ("Build 2071-16-2361, TCK-5873-98297, 10.0.32.1:8080, Epoch 1706032888, moorcli@1.2.3, CVE-2095-38555, 0x7089-0x9668", []),
    ("Drops Hazel Router support on Lane 3.", []),
    ("", []),
    (None, []),
]


@pytest.mark.parametrize(("text", "want"), FOUND)
def test_personal_items(text, want):
    found = pii.find(text)
    got = [(k, text[b:e]) for k, b, e in found]
    assert got == want
    out = pii.replace(text, found)
    assert out is None if text is None else all(v not in out for _, v in want)


HOSTILE = {
    "apostrophes": "'" * 100_000 + "@", "blanks": "at " + " " * 100_000 + "x", "dashes": "at " + "a-" * 100_000, "letters": "SSN " + "a" * 100_000,
    "announced": "SSN " + "a-" * 100_000, "initials": "@ " + "A " * 100_000, "hyphens": "thanks to " + "Aa-" * 50_000 + "!", "mails": "a@b." * 50_000,
    "numbers": "+1 " * 100_000, "street": "12 " + "A" * 100_000, "names": "Aa Bb <" * 20_000 + "@", "commas": "Aa, " * 50_000 + "aa@bb.example",
    "owners": " ".join(f"Smith Smith{'x' * (k % 40)} j{k}smith@b.example" for k in range(10_000)),
}


@pytest.mark.parametrize("kind", sorted(HOSTILE))
def test_hostile_texts_take_linear_time(kind):
    began = time.process_time()
    pii.find(HOSTILE[kind])
    assert time.process_time() - began < 4


def test_an_address_names_its_owner_without_a_cue():
    text = "Zoë Caldestaro saw it first, then Tom Mann too. Questions: zoe.caldestaro@corp.example"
    assert [(k, text[a:b]) for k, a, b in pii.find(text)] == [("name", "Zoë Caldestaro"), ("email", "zoe.caldestaro@corp.example")]
    text = "Quorum Builder broke. Ann Lee wrote to builder@corp.example"
    assert [(k, text[a:b]) for k, a, b in pii.find(text)] == [("email", "builder@corp.example")]


def test_address_field():
    show = lambda t: [(k, t[b:e]) for k, b, e in pii.find_in_address_field(t)]
    assert show("ann@x.example") == show(" ann@x.example ") == []
    assert show("Ann Lee <ann@x.example>") == [("name", "Ann Lee"), ("email", "ann@x.example")]
    assert show("ann [at] x [dot] example") == [("email", "ann [at] x [dot] example")]
    assert show("mailto:ann@x.example (Ann Lee)") == [("email", "ann@x.example"), ("name", "Ann Lee")]
    assert show("ann@x.example, tel 212.555.0109") == [("email", "ann@x.example"), ("phone", "212.555.0109")]


def test_personal_items_of_a_table(spark):
    rows = [("c", "a@x.example a@x.example", None), ("c", "a@x.example a@x.example", None), ("d", None, "Ann Lee <b@x.example>"), (None, "", ""), ("l", "x " * 200_000 + "z@y.example", None)]
    df = spark.createDataFrame([(*r, "f") for r in rows], "id string, message string, mail string, field string")
    ways = {"message": "text", "mail": "address"}
    got = {tuple(r) for r in pii.personal_items(df, "id", ways).collect()}
    assert got == {("c", "message", "email", "a@x.example"), ("d", "mail", "name", "Ann Lee"), ("d", "mail", "email", "b@x.example"), ("l", "message", "email", "z@y.example")}
    assert sorted(str(r.message)[-7:] for r in pii.redacted(df, "id", ways).collect()) == sorted(["[EMAIL]", "[EMAIL]", "None", "", "[EMAIL]"])
    assert pii.personal_items(df.limit(0), "id", ways).count() == 0


SENTENCES = ["The cache of {0} stays empty until {1} has been flushed twice.", "We saw {0} retry the same request because {1} was never closed.", "Nothing reads {0} after {1} returns, so the check can go away."]
NAMES = "slider gateway broker planner widget mutex codec ledger".split()


@pytest.mark.parametrize("sample", [tr.SAMPLE, 40_000])
def test_truncation(spark, monkeypatch, sample):
    monkeypatch.setattr(tr, "SAMPLE", sample)
    rng = random.Random(7)
    line = lambda: rng.choice(SENTENCES).format(rng.choice(NAMES), rng.choice(NAMES))
    rows, want = [], set()
    for k in range(900):
        text = " ".join(line() for _ in range(rng.randrange(2, 5)))
        kind = k % 9
        if kind == 0:
            text, cut = text[: -rng.randrange(6, 25)].rstrip(), True
            text += rng.choice(["", "", "...", " [...]"])
        else:
            cut = False
            text = {1: text[:-1], 2: text + " And so on...", 3: text + "\n\n-- \nAnn", 4: text + "\n\nRefs: #12", 5: text + "\n\n```\nx = 1\n```"}.get(kind, text)
        rows.append((k, text, "en", "s"))
        if cut:
            want.add(k)
    rows += [(2000, None, "en", "s"), (2001, "  ", None, "s"), (2002, "", "en", "s"), (2003, "broken �", None, None), (2004, "```\nopen", "xx", "s"), (2005, "w " * 100_000 + ".", "en", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, verdict string")
    got = {r.doc_id: r.truncated for r in tr.score_endings(df, "doc_id", "text", "lang").collect()}
    assert not {2000, 2001, 2002} & set(got) and got[2003] and got[2004] and not got[2005]
    found = {k for k, cut in got.items() if cut and k < 2000}
    assert len(found & want) >= 0.95 * len(want) and len(found - want) <= 0.02 * len(rows)
    assert tr.score_endings(df.limit(0), "doc_id", "text", "lang").count() == 0


def test_all_texts_are_counted_whatever_the_passes(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(k, " ".join(rng.choice(SENTENCES).format(rng.choice(NAMES), rng.choice(NAMES)) for _ in range(3))[: rng.choice([40, 90, 999])], "en") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    scored = []
    for sample in (tr.SAMPLE, 400):
        monkeypatch.setattr(tr, "SAMPLE", sample)
        scored.append({r.doc_id: (r.verdict, round(r.log_odds, 9), r.truncated) for r in tr.score_endings(df, "doc_id", "text", "lang").collect()})
    assert scored[0] == scored[1] and len(scored[0]) == 300


def test_a_stop_that_never_closes_anything_is_a_cut(spark):
    rng = random.Random(8)
    lines = ["Die Werte sind klein, z. B. bei null, wie hier.", "Er prüft alles, z. B. die Länge.", "Das ist gut.", "Wir warten auf den Lauf."]
    rows = [(k, " ".join(rng.choice(lines) for _ in range(6)), "de") for k in range(400)]
    rows += [(1000, "Das ist gut. Er prüft alles, z. B.", "de"), (1001, "Das ist ganz neu!", "de"), (1002, "https://host.example/a/b?", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id for r in tr.score_endings(df, "doc_id", "text", "lang").where("truncated").collect()}
    assert got == {1000}


def test_a_rare_language_is_drawn_towards_all(spark):
    """A language of few endings is judged nearly as the corpus, one of many by itself; nothing depends on how many languages there are."""
    rng = random.Random(9)
    text = lambda cut: (" ".join(rng.choice(SENTENCES).format(rng.choice(NAMES), rng.choice(NAMES)) for _ in range(4)))[: -9 if cut else -1]
    rows = [(k, text(k % 2 == 0), "en" if k < 800 else f"l{k}") for k in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.truncated for r in tr.score_endings(df, "doc_id", "text", "lang").collect()}
    for low, high in ((0, 800), (800, 1200)):
        found, want = {k for k in range(low, high) if got[k]}, {k for k in range(low, high) if k % 2 == 0}
        assert len(found & want) >= 0.95 * len(want) and len(found - want) <= 0.05 * len(want)


def test_final_keys_equal_those_of_a_scan():
    texts = ["x", "abcdefgh ij", "ab" * 30, "日本語のテキスト、です"]
    for text, keys in zip(texts, tr._final_keys(texts, [False] * 4), strict=True):
        whole = {order: int(h[-1].view(np.int64)) for order, h in tr._hashes(tr._points(text))}
        assert keys == [whole.get(order) if len(text) >= order else None for order in tr.ORDERS]
