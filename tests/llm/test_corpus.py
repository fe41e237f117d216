"""Token ids, mixing and file provenance: against the plain tokenizer, planted cases, and edge cases."""

from __future__ import annotations

import random
import time
from collections import defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronolith.llm import mixing as mx
from chronolith.llm import provenance as pv
from chronolith.llm import tokens as tk

needs_vocabulary = pytest.mark.skipif(not Path(tk.TOKENIZERS).exists(), reason="no vocabulary files here")


def plain(text):
    return tk.encoder()[0].encode_ordinary(text) if text else []


@needs_vocabulary
@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.one_of(st.sampled_from("ab '’s\n\t 　 é中日…!?.0½🙂\u0085_-"), st.characters(exclude_categories=["Cs"])), max_size=80)), max_size=6))
def test_ids_equal_the_plain_tokenizer(texts):
    ids, sizes = tk.FragmentEncoder().batch(pa.array(texts, pa.string()))
    at = 0
    for text, size in zip(texts, sizes.tolist(), strict=True):
        assert ids[at : at + size].tolist() == plain(text)
        at += size
    assert at == len(ids)


@needs_vocabulary
def test_ids_of_a_table(spark, monkeypatch):
    monkeypatch.setattr(tk, "HELD", 3)
    texts = ["it's  so\n\n far", None, "", "a" * 20_000, "中文" * 5000, " <|endoftext|>", "x y z " * 50_000]
    df = spark.createDataFrame([(i, t, "e") for i, t in enumerate(texts)] + [(0, texts[0], "e")], "doc_id long, text string, ids string")
    rows = tk.token_ids(df, "doc_id", "text").collect()
    assert len(rows) == len(texts) + 1
    assert all(list(r.ids) == plain(texts[r.doc_id]) for r in rows)
    counts = tk.token_counts(df, ["doc_id"], "text").collect()
    assert all(r.n_tokens == len(plain(texts[r.doc_id])) for r in counts)
    assert tk.token_ids(df.limit(0), "doc_id", "text").count() == 0
    text = tk.encoder()[0].decode(list(rows[0].ids))
    assert text == texts[rows[0].doc_id], "exact round trip"


def test_water_filling():
    targets = [mx.Target("a", 0.5, 1), mx.Target("b", 0.3, 4), mx.Target("c", 0.2, 1)]
    have = {"a": 100, "b": 100, "c": 1000}
    given_ = mx.water_fill(have, targets)
    assert given_ == pytest.approx({"a": 100, "b": 60, "c": 40})
    given_ = mx.water_fill(have, targets, 1000)
    assert given_ == pytest.approx({"a": 100, "b": 400, "c": 500}), "what a cannot give goes to b and c by their shares, then b is clamped"
    assert sum(mx.water_fill(have, targets, 10_000).values()) == pytest.approx(100 + 400 + 1000)
    assert mx.water_fill({}, targets) == {"a": 0.0, "b": 0.0, "c": 0.0}
    assert mx.water_fill({"b": 10}, targets)["b"] == pytest.approx(40)


def test_mixture(spark):
    rng = random.Random(8)
    rows = [(k, rng.choice(["a", "a", "a", "b", "c", None, "other"]), rng.randrange(0, 50)) for k in range(4000)]
    sized = spark.createDataFrame([(*r, "x") for r in rows], "id long, origin string, tokens long, source string").repartition(5)
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.2, 2), ("none", 0.0, 1)], "source string, target_share double, max_repeats int")
    used = mx.mix(sized, targets, "id", "origin", "tokens")
    got = used.collect()
    assert len({r.id for r in got}) == len(got)
    most = defaultdict(int)
    for r in got:
        most[r.origin] = max(most[r.origin], r.repeats)
    assert set(most) == {"a", "b", "c"} and most["a"] <= 1 and most["b"] <= 3 and most["c"] <= 2
    shares = {r.source: r.reached_share for r in mx.reached(used, targets, "origin", "tokens").collect()}
    assert shares == pytest.approx({"a": 0.5, "b": 0.3, "c": 0.2, "none": 0.0}, abs=0.003)
    assert sorted(map(str, used.collect())) == sorted(map(str, got)), "the same rows every time"
    capped = mx.mix(sized, targets, "id", "origin", "tokens", fill=0.95)
    capped = {r.source: (r.size_used, r.most_repeats) for r in mx.reached(capped, targets, "origin", "tokens").collect()}
    sizes = {s: sum(t for _, o, t in rows if o == s) for s in "abc"}
    assert capped["c"] == (2 * sizes["c"], 2) and capped["b"] == (3 * sizes["b"], 3) or capped["a"] == (sizes["a"], 1), "at least one source is clamped"
    assert sum(n for n, _ in capped.values()) == pytest.approx(0.95 * (sizes["a"] + 3 * sizes["b"] + 2 * sizes["c"]), abs=150)
    empty = mx.mix(sized.limit(0), targets, "id", "origin", "tokens")
    assert empty.count() == 0 and mx.reached(empty, targets, "origin", "tokens").first().size_used == 0


OWN = "\n".join(f"def f{chr(97 + k % 26)}(x):\n    if x > {k}:\n        return x + other\n    call(x, y)\n" for k in range(3))
SIGNS = [
    ("a.py", OWN, None),
    ("vendor_x/a.py", OWN, None),
    ("src/generated_a.min.js", OWN, None),
    ("a.py", "# Copyright (c) 2021 codeharbor contributors\n" + OWN, None),
    ("a.py", "# replaces the vendored lodetest copy we used to carry\n" + OWN, None),
    ("a.py", OWN + '\nheader = "Code generated by our tool. DO NOT EDIT."\n', None),
    ("a.py", "# Note that oxbowfs 1.2.3 sorts differently, so this pins the late form.\n" + OWN, None),
    ("a.py", OWN + "\n# " + ", ".join(map(str, range(100))) + "\n", None),
    ("a.py", "# Code generated by stubmill 1.2.3. DO NOT EDIT.\n" + OWN, "generated"),
    ("a.py", "# Erzeugt von stubmill 1.2, nicht bearbeiten\n" + OWN, "generated"),
    ("a.go", "\n".join(f"const Lease_{k} = {8 * k}" for k in range(40)), "generated"),
    ("a.js", "".join(f"function v{k}(p,x){{if(p>x){{return v(x,p)}}return p?x:v}}" for k in "abcdefghijkl"), "minified"),
    ("a.h", "static const unsigned char X[] = {\n" + "\n".join("  " + ", ".join(f"0x{(k * j) % 256:02x}" for j in range(14)) + "," for k in range(30)) + "\n};\n", "data"),
    ("a.js", 'X = ""\n' + "\n".join(f'X += "{"Ab1+/" * 15}"' for _ in range(10)), "data"),
    ("app/third_party/lodetest/a.py", OWN, None),
    ("a.py", "# Imported unchanged from oxbowfs 2012; report bugs upstream.\n" + OWN, "vendored"),
    ("a.c", "// Copyright (c) 2011 the fenstream authors. Redistribution permitted under the Fernleaf licence.\n" + OWN, "vendored"),
]


@pytest.mark.parametrize(("path", "text", "sign"), SIGNS)
def test_signs(path, text, sign):
    assert pv.own_signs(*pv.split_comments(text))[0] == sign


def _code(rng, lines):
    word = lambda: rng.choice("alpha beta gamma delta omega sigma kappa theta".split()) + str(rng.randrange(50)) + "x"
    shapes = ["{0} = {1}({2}, {3})", "if {0} > 3:\n    {1}.{2}({3})", "for {0} in {1}:\n    {2} += {3}", "return {0} + {1}[{2}]", "{0}.{1}({2}).{3}(4)", "while {0}:\n    {1}()", "{0}, {1} = {2}"]
    return "\n".join(rng.choice(shapes).format(*(word() for _ in range(4))) for _ in range(lines))


def _judged(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1) for r in rows], "path string, content string, row int")
    return pv.foreign_files(df.repartition(3), "path", "content", **options).collect()


def test_a_copy_in_many_repositories_is_vendored(spark):
    rng = random.Random(9)
    copy = _code(rng, 80)
    rows = [(f"libs/p{k}/src/c.py", "# own words\n" + copy.replace(" = ", "  =  ")) for k in range(4)] + [(f"libs/p{k}/src/own.py", _code(rng, 80)) for k in range(4)]
    rows += [("libs/p1/again.py", rows[5][1]), ("libs/p1/null.py", None), ("libs/p1/blank.py", " \n"), (None, "x"), ("long.py", _code(rng, 10) * 300)]
    got = {r.path: (r.reason, r.evidence) for r in _judged(spark, rows)}
    assert {p: why for p, why in got.items() if why[0]} == {f"libs/p{k}/src/c.py": ("vendored", "copy") for k in range(4)}
    assert len(got) == len(rows) - 3
    assert _judged(spark, rows[:0] or [(None, None)]) == []


def test_fingerprints_alone_find_edited_copies(spark):
    rng = random.Random(10)
    rows = []
    for n in range(60):
        text = _code(rng, 90).split("\n")
        for k in range(4):
            lines = [x for i, x in enumerate(text) if i % 30 != 5 * k]
            lines.insert(rng.randrange(len(lines)), _code(rng, 1))
            rows.append((f"project{(n + k) % 40}/f{n}.py", "\n".join(lines)))
    rows += [(f"project{k}/own{k}.py", _code(rng, 90)) for k in range(40)]
    got = {r.path: r.reason for r in _judged(spark, rows, signs=False)}
    found = {p for p, reason in got.items() if reason}
    assert not any("/own" in p for p in found)
    assert len(found) >= 0.9 * 240


def test_a_fingerprint_of_most_files_is_one_row_of_a_broadcast(spark):
    """Half of all files begin alike; the shares are those of a plain count."""
    rng = random.Random(12)
    common = _code(rng, 60)
    rows = [(f"p{k}/a.py", common + "\n" + _code(rng, 20 + k % 50)) for k in range(80)] + [(f"p{k}/b.py", _code(rng, 60)) for k in range(80)]
    prints = {path: [set(x.tolist()) for x in pv.fingerprints(pv.split_comments(text)[1])[:2]] for path, text in rows}
    repos = [defaultdict(set), defaultdict(set)]
    for path, pair in prints.items():
        for kind in (0, 1):
            for x in pair[kind]:
                repos[kind][x].add(pv.repository(path))
    for r in _judged(spark, rows):
        want = [sum(len(repos[k][x]) > pv.OTHERS for x in s) / len(s) if s else 0.0 for k, s in enumerate(prints[r.path])]
        assert [r.recurring, r.form_recurring] == pytest.approx(want)


def test_what_a_program_wrote_is_known_by_its_form(spark):
    rng = random.Random(13)
    names = lambda: "".join(rng.sample("abcdefghijklmnop", 6))
    made = lambda: "\n".join(f"def get_{names()}(self):\n    return self.{names()}[{rng.randrange(90)}]" for _ in range(rng.randrange(20, 40)))
    rows = [(f"p{k}/made.py", made()) for k in range(5)] + [(f"p{k}/own.py", _code(rng, 90)) for k in range(5)]
    got = {r.path: (r.reason, r.evidence) for r in _judged(spark, rows, signs=False)}
    assert {p for p, why in got.items() if why == ("generated", "form")} == {f"p{k}/made.py" for k in range(5)}
    assert {p for p, why in got.items() if why == (None, None)} == {f"p{k}/own.py" for k in range(5)}


def test_a_package_folder_alone_decides_nothing(spark):
    notice = "# Imported unchanged from oxbowfs 2012; report bugs upstream.\n"
    rows = [("src/external/payments/client.py", OWN), ("app/deps/core/pool.py", OWN + "x = 1\n"), ("app/vendor/oxbowfs/a.py", OWN + "y = 2\n"), ("lib/b.py", notice + OWN + "z = 3\n")]
    rows += [("app/deps/zip-1.2/c.py", OWN + "u = 1\n")] + [(f"q{k}/vendor/lodetest/d.py", OWN + f"v{k} = 1\n") for k in range(3)]
    got = {r.path: r.evidence for r in _judged(spark, rows)}
    assert got == {
        "src/external/payments/client.py": None, "app/deps/core/pool.py": None, "app/vendor/oxbowfs/a.py": "package", "lib/b.py": "sign",
        "app/deps/zip-1.2/c.py": "package", **{f"q{k}/vendor/lodetest/d.py": "package" for k in range(3)},
    }


def test_winnowing_equals_its_definition():
    rng = np.random.default_rng(3)
    stream = rng.integers(0, 2**63, 300).astype(np.uint64)
    got = set(pv.winnow(stream, 25, 16).tolist())
    moved = set(pv.winnow(np.r_[stream[50:], stream[:20]], 25, 16).tolist())
    assert len(got & moved) >= 0.7 * len(got), "fingerprints do not depend on where a run lies"
    assert pv.winnow(stream[:24], 25, 16).size == 0 and pv.winnow(stream[:25], 25, 16).size == 1
    assert pv.winnow(stream, 25, 16, np.zeros(300, np.int64), 1).size == 0


@pytest.mark.parametrize(("notice", "sign"), [("Code generated by schemac", "generated"), ("@generated", "generated"), ("Version 1.4.2 of quickzip, imported from upstream", "vendored"), ("Ours", None)])
def test_a_notice_behind_a_full_licence_text(notice, sign):
    licence = "\n".join("// Unless agreed to in writing, the software is provided as it is, without any warranty." for _ in range(150))
    assert pv.own_signs(*pv.split_comments(f"{licence}\n// {notice}\nfn main() {{\n    let x = read(1);\n}}\n"))[0] == sign


def test_a_long_head_is_read_in_linear_time():
    began = time.process_time()
    assert pv.own_signs(*pv.split_comments("//\n" * 100_000 + "// " + "distributed " * 50_000 + "\n// Copyright 2020 The Zip Authors\nfn main() {}\n"))[0] is None
    assert time.process_time() - began < 10
