"""Pairs of items, top items and names: against brute force, and edge cases."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from chronolith.llm import blocks as bl
from chronolith.llm import cooccurrence as co
from chronolith.llm import names as nm
from chronolith.llm import sizes
from chronolith.llm.graph import components
from chronolith.llm.topn import top_n

SCHEMA = "basket string, item string, left string, id long"


def brute(rows, min_count, min_lift):
    baskets = defaultdict(set)
    for b, i in rows:
        if b is not None and i is not None:
            baskets[b].add(i)
    n = len(baskets)
    single = Counter(i for s in baskets.values() for i in s)
    pairs = Counter(p for s in baskets.values() for p in combinations(sorted(s), 2))
    return {(a, b, k) for (a, b), k in pairs.items() if k >= min_count and k * n >= min_lift * single[a] * single[b]}


@pytest.mark.parametrize(("block", "flush", "shard"), [(256, 2_000_000, 100_000), (3, 50, 2)])
def test_pairs_equal_brute_force(spark, monkeypatch, block, flush, shard):
    monkeypatch.setattr(co, "BLOCK", block)
    monkeypatch.setattr(co, "FLUSH", flush)
    monkeypatch.setattr(co, "SHARD_BASKETS", shard)
    rng = random.Random(1)
    rows = [(f"b{rng.randrange(120)}", f"i{int(rng.paretovariate(0.8)) % 40}") for _ in range(1500)]
    rows += [("big", f"i{k}") for k in range(40)] + [(None, "i1"), ("b1", None), ("b2", ""), ("b2", "ü")] + rows[:50]
    df = spark.createDataFrame([(b, i, "x", 1) for b, i in rows], SCHEMA)
    got = co.cooccurring(df.repartition(3), "basket", "item", min_count=3, min_lift=1.2, llr=0.0).collect()
    assert {(r.item_a, r.item_b, r.n_ab) for r in got} == brute(rows, 3, 1.2)
    assert all(r.item_a < r.item_b and r.lift >= 1.2 for r in got)


@pytest.mark.parametrize("rows", [500_000, 1])
def test_a_giant_basket_is_spread_over_tasks(spark, monkeypatch, rows):
    """One basket holds two thirds of all rows; no task makes more than a few of its block pairs."""
    monkeypatch.setattr(co, "BLOCK", 40)
    monkeypatch.setattr(co, "small_side", lambda df, limit=rows: sizes.small_side(df, limit))
    data = [("giant", f"i{k:03}") for k in range(600)] + [(f"b{k % 60}", f"i{(7 * k) % 150:03}") for k in range(300)]
    df = spark.createDataFrame(data, "basket string, item string")
    got = {(r.item_a, r.item_b, r.n_ab) for r in co.cooccurring(df, "basket", "item", 2, 1.0, 0.0).collect()}
    assert got == brute(data, 2, 1.0) and got
    coded = df.where("basket = 'giant'").selectExpr("basket", "named_struct('id', xxhash64(item), 'shards', 1L) as entry", "16L as blocks")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # these few bytes would become one task
    spread = co._block_pairs(coded).select(F.spark_partition_id().alias("task"), (F.size("left") * F.greatest(F.size("right"), F.lit(1))).alias("pairs"))
    by_task = [r.pairs for r in spread.groupBy("task").agg(F.sum("pairs").alias("pairs")).collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(by_task) == 4 and max(by_task) < 0.5 * sum(by_task)


def test_no_pairs(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert co.cooccurring(empty, "basket", "item").count() == 0
    one = spark.createDataFrame([("a", "x", None, None)], SCHEMA)
    assert co.cooccurring(one, "basket", "item", 1, 1.0, 0.0).count() == 0


def test_ratio_of_independent_items_is_zero(spark):
    row = spark.range(1).select(co.log_likelihood(*(F.lit(float(x)) for x in (10, 20, 50, 100))).alias("r")).first()
    assert abs(row.r) < 1e-9


def test_top_n_equals_plain_ranking(spark):
    rng = random.Random(2)
    rows = [(rng.choice("aaaaab") if k % 50 else None, rng.choice([1.0, 2.0, None]), f"k{k:04}", "s") for k in range(2000)]
    df = spark.createDataFrame(rows, "g string, score double, key string, other string")
    got = {(r.g, r["rank"], r.key) for r in top_n(df, ["g"], [F.desc_nulls_last("score")], "key", 3, 4).collect()}
    groups = defaultdict(list)
    for g, s, k, _ in rows:
        groups[g].append((-s if s is not None else float("inf"), k))
    assert got == {(g, i + 1, k) for g, v in groups.items() for i, (_, k) in enumerate(sorted(v)[:3])}
    assert top_n(df.limit(0), ["g"], [F.desc("score")], "key").count() == 0
    with pytest.raises(ValueError):
        top_n(df.withColumn("rank", F.lit(1)), ["g"], [F.desc("score")], "key")


def test_top_n_of_equal_rows(spark):
    df = spark.createDataFrame([("a", 1.0, "k")] * 5, "g string, score double, key string")
    assert [r["rank"] for r in top_n(df, ["g"], [F.desc("score")], "key", 3).collect()] == [1, 2, 3]


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5), (7, None)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if b is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


PEOPLE = {
    "same": [
        (1, "Patricia Fenandt", "patricia.fenandt@corp.example"), (2, "FENANDT, Pat", "pfenandt@corp.example"), (3, "P. Fenandt", "pfenandt@corp.example"),
        (4, "fenandtp", "fenandtp@mail.example"), (5, "Patircia Fenandt", "77+patfenandt@users.noreply.example"), (6, "Patricia Fenadnt", "patricia@fenandt.example"),
        (7, "Patricia Fenandt-Holm", "pfenandt@corp.example"), (8, "Pat", "patricia.fenandt@corp.example"), (9, "Patricia Fenandt", "team@corp.example"),
        (10, "patricia.fenandt@corp.example", "patricia.fenandt@corp.example"), (11, "Fenandt Patricia", "Patricia Fenandt <pf@x.example>"),
    ],
    "family": [(20, "Robert Fenandt", "robert.fenandt@corp.example"), (21, "Bob Fenandt", "bob@fenandt.example")],
    "shared": [(30, "Ilse Quaellmer", "team@corp.example")],
    "org": [(40, "Lomoben Runtime Team", "runtime@lomoben.example"), (41, "Runtime Team at Lomoben", "runtime-team@lomoben.test"), (42, "Lomobenn Runtime Team", "runtime@lomoben.example")],
    "unit": [(43, "Lomoben Release Team", "release@lomoben.example")],
    "bot": [(50, "deps-updater[bot]", "deps@bots.example")],
    "nobody": [(60, None, None)],
    "blank": [(61, "", "")],
}


FORMS = {"patricia": ["pat"], "robert": ["bob", "rob"], "theodore": ["theo"], "ilse": [], "zoe": [], "rebecca": []}


def teaching(forms, first_id=10_000):
    """Rows that show given names and their forms: each beside three family names that no other row has."""
    rows = []
    for name, others in forms.items():
        for k, tail in enumerate(("quorv", "zeltim", "bructo")):
            family = f"{name[::-1]}{tail}"
            rows.append((first_id + len(rows), f"{name} {family}".title(), f"{name[0]}{family}@corp{k}.example"))
            for short in others:
                rows.append((first_id + len(rows), f"{short} {family}".title(), f"{name}.{family}@home{k}.example"))
    return rows


def _linked(spark, rows, forms=FORMS):
    df = spark.createDataFrame(rows + teaching(forms), "author_id long, name string, email string")
    pairs = nm.entity_pairs(nm.link_names(df, "author_id", "name", "email"), "author_id").collect()
    return {(r.author_id_a, r.author_id_b) for r in pairs if r.author_id_a < 10_000}


def test_names(spark):
    rows = [(i, n, e) for group in PEOPLE.values() for i, n, e in group]
    want = {p for group in PEOPLE.values() for p in combinations(sorted(i for i, _, _ in group), 2)}
    assert _linked(spark, rows) == want


def test_other_columns_are_not_read(spark):
    df = spark.createDataFrame([(1, "Ann Lee", "ann.lee@a.example", "x", "y"), (2, "Ann Lee", None, None, "z")], "author_id long, name string, email string, family string, row string")
    assert {r.entity for r in nm.link_names(df, "author_id", "name", "email").collect()} == {1}


def _slipped(rng, word):
    k = rng.randrange(1, len(word) - 1)
    return rng.choice([word[:k] + word[k + 1 :], word[:k] + word[k + 1] + word[k] + word[k + 2 :], word[:k] + word[k] * 2 + word[k + 1 :]])


def test_people_of_names_in_no_list(spark):
    """Invented given names and forms: what they are is learned from the rows themselves."""
    rng = random.Random(14)
    syllables = "ka lo mi tru ven sor dal hup nek tis bra jol wim fad".split()
    word = lambda n: "".join(rng.choice(syllables) for _ in range(n))
    given = {word(3): [word(2)[:4]] for _ in range(12)}
    families = [word(4) + "x" for _ in range(160)]
    rows, people = [], {}
    for k, family in enumerate(families):
        name = rng.choice(sorted(given))
        short, fam, low = rng.choice(given[name]).title(), family.title(), name.title()
        ways = [
            (f"{low} {fam}", f"{name[0]}{family}@corp.example"), (f"{low} {fam}", f"{name}.{family}@corp.example"), (f"{short} {fam}", f"{name}.{family}@home.example"),
            (f"{fam}, {low}", None), (f"{name[0].upper()}. {fam}", None), (f"{name[0]}{family}", f"{name[0]}{family}@mail.example"), (f"{low} {_slipped(rng, fam.lower()).title()}", None),
            (f"{short} {fam}", None), (f"{fam} {low}", f"{family}@x{k}.example"),
        ]
        for n, e in rng.sample(ways, 4):
            people[len(rows)] = k
            rows.append((len(rows), n, e))
    want = {(a, b) for a, b in combinations(people, 2) if people[a] == people[b]}
    got = _linked(spark, rows, {})
    assert len(got & want) >= 0.93 * len(want) and len(got - want) <= 0.01 * len(want)
    assert {r.word for r in nm.lexicon(spark.createDataFrame(rows, "id long, name string, email string").select("name", "email")).collect()} >= set(given)


@pytest.mark.parametrize("most", [1, 500_000])
def test_a_lexicon_of_any_size_gives_the_same(spark, monkeypatch, most):
    monkeypatch.setattr(nm, "small_side", lambda df: sizes.small_side(df, most))
    rows = [(1, "Bob Fenandt", None), (2, "Robert Fenandt", None), (3, "Rob Fenandt", "x@y.example"), (4, "Zoe Fenandt", None), (4, "Zoe Fenandt", None)]
    assert _linked(spark, rows) == {(1, 2), (1, 3), (2, 3)}


def test_forms_are_learned_from_large_families_too(spark, monkeypatch):
    """All families have more given names than ``MOST_GIVEN``; a giant one and chance make no forms."""
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    given = sorted({word(rng.randrange(5, 9)) for _ in range(300)})
    rows = []
    for k in range(150):
        family = word(10)
        own = given if k == 0 else rng.sample(given, 45)
        own = [*own, *(["zacharius"] if k % 3 == 0 else []), *(["zeke"] if k % 3 == 0 and k % 4 else [])]
        rows += [(f"{g.title()} {family.title()}", f"{g[0]}{family}@corp.example") for g in own]
    df = spark.createDataFrame(rows, "name string, email string")
    for part in (bl.PART, 20):
        monkeypatch.setattr(nm, "large_blocks", lambda *x, part=part: bl.large_blocks(*x, part))
        words = {r.word: dict(r.fulls) for r in nm.lexicon(df).collect()}
        assert words["zeke"] == words["zacharius"] == {"zacharius": ["zacharius", "zeke"]}
        assert len(words) > 250 and all(list(fulls) == [w] for w, fulls in words.items() if w != "zeke")


def test_an_initial_that_fits_two_people_links_neither(spark):
    rows = [(1, "Rebecca Ulvoc", "rebecca@ulvoc.example"), (2, "Robert Ulvoc", "robert@ulvoc.example"), (3, "R. Ulvoc", "ru@x.example")]
    assert _linked(spark, rows) == set()


def test_no_names(spark):
    df = spark.createDataFrame([], "author_id long, name string, email string")
    assert nm.entity_pairs(nm.link_names(df, "author_id", "name", "email"), "author_id").count() == 0


def test_a_block_larger_than_the_limit_loses_no_whole_name(spark, monkeypatch):
    monkeypatch.setattr(nm, "MOST_ROWS", 2)
    assert len(_linked(spark, [(k, "Robert Fenandt", f"x{k}@mail.example") for k in range(9)], {})) == 36


@pytest.mark.parametrize("most", [2, 60])
def test_a_family_larger_than_a_block_loses_no_variant(spark, monkeypatch, most):
    monkeypatch.setattr(nm, "MOST_ROWS", most)
    rng = random.Random(5)
    others = [(100 + k, f"{rng.choice('PQR') if k % 2 else 'J'}{'aeiou'[k % 5]}{''.join(rng.sample('bcdfghjklmnpqrstvwxz', 8))} Fenandt", None) for k in range(150)]
    rows = [
        (1, "Theodore Fenandt", "theodore.fenandt@a.example"), (2, "T. Fenandt", None), (3, "Fenandt, T.", "x@y.example"), (4, "Theodroe Fenandt", None),
        (5, "tfenandt", "tfenandt@b.example"), (6, "Fenandt, Theo", None), (7, "Theodore Fenadnt", None), (8, "J. Fenandt", None),
    ]
    assert _linked(spark, rows + others) == set(combinations(range(1, 8), 2))


def test_blocks_hold_every_pair_the_comparison_accepts(spark, monkeypatch):
    monkeypatch.setattr(nm, "MOST_ROWS", 3)
    rng = random.Random(6)
    families, given = ["Fenandt", "Fenadnt", "Fenand", "Kim", "Lee", "Ulvoc", "Ulvocc", "Ulvcoc"], ["Robert", "Bob", "R.", "Rob", "Roebrt", "Ilse", "I.", "Il", "Zoe"]
    rows = []
    for k in range(120):
        f, g = rng.choice(families), rng.choice(given)
        name = rng.choice([f"{g} {f}", f"{f}, {g}", f"{g[0]}{f}".lower(), f"{f} Runtime Team", f"The Team {f} Labs", f"{f.lower()}-bot", g])
        rows.append((k, name, rng.choice([None, f"{g[0]}{f}@x.example".lower(), f"{g}.{f}@y.example".lower().replace("..", "."), f"{g}@{f}.example".lower().replace(".@", "@")])))
    df = spark.createDataFrame(rows + teaching(FORMS), "id long, name string, email string")
    found = nm._with_names(df, nm.lexicon(df)).where("id < 10000")
    readings = nm._readings(found.mapInPandas(nm._read, f"id long, {nm.READING}")).checkpoint()
    own = {r.reading: {**r.asDict(), "least": None} for r in readings.collect()}
    want = {(a, b) for a in own for b in own if (a < b or a == b and own[a]["n"] > 1) and nm.compare(own[a], own[b])}
    met = {(r.a, r.b) for r in nm._pairs(readings).collect()}
    assert len(want) > 50 and want <= met


def test_repeated_keys_are_one_node(spark):
    rows = [(1, "Robert Fenandt", None), (1, "Ilse Ulvoc", None), (2, "Bob Fenandt", None), (3, "Ilse Ulvoc", None), (4, "Zoe Ulvoc", None)]
    assert _linked(spark, rows) == {(1, 2), (1, 3), (2, 3)}


@pytest.mark.parametrize("family", ["Kim", "Wang"])
def test_variants_of_short_family_names(spark, family):
    low = family.lower()
    rows = [
        (1, f"Theodore {family}", f"theodore.{low}@a.example"), (2, f"T. {family} <t.{low}@b.example>", f"t.{low}@b.example"), (3, f"{family}, Theodroe", None),
        (4, f"t{low}", f"t{low}@c.example"), (5, f"{family}, Theo", "x@y.example"), (6, f"theo.{low}", None), (7, f"Ilse {family}", f"ilse@{low}.example"),
    ]
    assert _linked(spark, rows) == set(combinations(range(1, 7), 2))


def test_subsequences():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = _next(row, x, b)
        return row[-1]

    def _next(row, x, b):
        out = [0]
        for j, y in enumerate(b):
            out.append(row[j] + 1 if x == y else max(row[j + 1], out[j]))
        return out

    rng = random.Random(4)
    for _ in range(200):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randrange(12))) for _ in range(2))
        assert nm.lcs(a, b) == plain(a, b)
    assert nm.one_slip("fenandt", "fenadnt")
    assert not nm.one_slip("fenandt", "fendnta")
