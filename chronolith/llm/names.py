"""Problem 7: rows of the same person or organisation, by blocking on suffixes and longest common subsequences.

What is a given name, and which given names stand for each other, is learned from the whole table (``lexicon``): a name
is a given name where it is typed behind a comma or shortened to its initial in the address; two given names are forms
of one where an address has the one beside the family name and the typed name the other, in several families. No list
of names is built in.

Every row is read into hypotheses: a family name with what is known of the given name (a full name, a few first
letters, or an initial), taken from the typed name and from the address; the suffixes of a login are readings of it,
so that an initial or a few letters before a family name do not hide it. Rows that read alike are compared once.
Readings meet by family name, by family names that a slip of the pen parts (found by the names less one letter), by
login or by a word of an organisation's name; these keys miss no pair that the comparison accepts. A large block is
cut into parts and every part meets every other. Pairs are compared by the ratio of their longest common subsequence;
an initial alone is accepted only where just one given name of the whole family fits it.
"""

from __future__ import annotations

import json
import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm.blocks import block_pairs, cells, large_blocks
from chronolith.llm.graph import components
from chronolith.llm.sizes import attach, small_side
from chronolith.session import cut

#: the shortest family name read from a login
MIN_FAMILY = 3
#: a block of more readings is cut into parts of this size
MOST_ROWS = 300
#: names are looked for in the first and in the last so many letters of a token
MOST_TOKEN = 40
#: copies of a lexicon too large to broadcast
SALTS = 16

UNITS = {"team", "group", "tm", "guild", "dept", "department", "grp", "crew", "squad", "committee", "foundation"}
FILLERS = {"at", "the", "of", "and", "for"}
LETTERS = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i", "þ": "th", "ð": "d"})


#: different family names that have to show a given name, or that two names are forms of one
SHOWN = 2
#: share of the families of a name that have another one, too, if both are forms of one
TOGETHER = 0.3
#: a name with a smaller share of the families of a name one letter apart is a slip of that one
SLIPS = 0.05
#: given names of a family up to which two of them are not held against chance
MOST_GIVEN = 30
#: full name -> all its forms, for every name a row can hold
Lexicon = dict[str, dict[str, list[str]]]


def fold(text: str) -> str:
    """Lower case without marks on letters."""
    text = unicodedata.normalize("NFKD", text.lower().translate(LETTERS))
    return "".join(c for c in text if not unicodedata.combining(c))


@lru_cache(maxsize=200_000)
def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence (bit-parallel)."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & masks.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def ratio(a: str, b: str) -> float:
    return 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 0.0


def one_slip(a: str, b: str) -> bool:
    """Whether one letter too many, too few, wrong or swapped parts the two."""
    return abs(len(a) - len(b)) <= 1 and lcs(a, b) >= max(len(a), len(b)) - 1


def address(email: str) -> str:
    """The bare lower-case address in a field that may hold more, or spell it out; empty if there is none."""
    text = re.sub(r"\s*[\[(]\s*at\s*[\])]\s*|\s+at\s+", "@", fold(email))
    text = re.sub(r"\s*[\[(]\s*dot\s*[\])]\s*|\s+dot\s+", ".", text)
    found = re.search(r"[a-z0-9._%+'-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)+", text)
    return found.group() if found else ""


class Typed(NamedTuple):
    """The parts of a row that names are read from."""

    typed: str
    words: list[str]
    mail: str
    local: str
    label: str
    parts: list[str]


def _parts(name: str | None, email: str | None) -> Typed:
    typed = fold(re.sub(r"\([^()]*\)", " ", name or "")).strip()
    mail = address(email or "")
    local, _, domain = mail.partition("@")
    local = re.sub(r"^\d+\+", "", local).split("+")[0]
    label = re.sub(r"-(?:box|mail|home)$", "", domain.split(".")[0])
    parts = [p for p in (re.sub(r"\d+$", "", t) for t in re.split(r"[._-]", local)) if p]
    return Typed(typed, re.findall(r"[^\W\d_]+", typed), mail, local, label, parts)


def _spaced(typed: str) -> list[str]:
    return [w for w in (re.sub(r"[^a-z.'-]", "", t) for t in typed.split()) if w]


def _letters(word: str) -> str:
    return re.sub(r"[^a-z]", "", word)


def _edges(token: str) -> Iterator[str]:
    """The beginnings and ends of a token that can be names."""
    for k in range(2, len(token) + 1):
        yield token[:k]
        yield token[-k:]


def probes(name: str | None, email: str | None) -> list[str]:
    """All strings of a row that ``parse`` may ask the lexicon about."""
    row = _parts(name, email)
    found = {_letters(w) for w in row.typed.split()} | set(row.words)
    for token in {*row.parts, row.label, *(p for w in _spaced(row.typed) for p in re.split(r"[._-]", w))}:
        found |= set(_edges(token[:MOST_TOKEN])) | set(_edges(token[-MOST_TOKEN:]))
    return sorted(x for x in found if len(x) > 1)


def evidence(name: str | None, email: str | None) -> list[tuple[str, str, str, str]]:
    """(``given``, word, "", beside), (``family``, word, "", beside), (``forms``, typed, addressed, beside) of a row.

    ``beside`` is the other name of the row, so that the same row many times over shows no more than once; a row of
    the kind ``beside`` just has the name that is typed as a given one and the family name.
    """
    row = _parts(name, email)
    if "@" in row.typed or len(row.words) > 4 or UNITS & set(row.words) or "bot" in row.words:
        return []
    out: list[tuple[str, str, str, str]] = []
    if "," in row.typed:
        left, right = (re.findall(r"[a-z]+", x) for x in row.typed.split(",", 1))
        pair = (right[0], left[0]) if left and right else None
    else:
        spaced = [_letters(w.split("-")[0]) for w in _spaced(row.typed)]
        pair = (spaced[0], spaced[-1]) if len(spaced) >= 2 else None
    if not pair:
        return []
    sure = "," in row.typed
    for given, family in [pair] if sure else [pair, pair[::-1]]:
        if len(given) < 3 or len(family) < MIN_FAMILY:
            continue
        joined = "".join(row.parts)
        if sure or joined in (given[0] + family, family + given[0]):
            out += [("given", given, "", family), ("family", family, "", given)]
        if row.label == family and row.local.isalpha() and len(row.local) >= 3 and row.local not in (given, family):
            out.append(("forms", given, row.local, family))
        if family in row.parts or joined.startswith(family) or joined.endswith(family):
            rest = joined.removesuffix(family) if joined.endswith(family) else joined.removeprefix(family) if joined.startswith(family) else ""
            if rest.isalpha() and len(rest) >= 3 and rest != given:
                out.append(("forms", given, rest, family))
    first, last = pair if sure or not any(k == "given" for k, *_ in out) else next((g, f) for k, g, _, f in out if k == "given")
    return [*out, ("beside", first, "", last)] if len(first) >= 3 and len(last) >= MIN_FAMILY else out


def _trimmed(token: str, known: set[str]) -> Iterator[tuple[str, str]]:
    """(family name, what is left of the given name) readings of a login."""
    yield token, ""
    for k in range(2, len(token) - MIN_FAMILY + 1):
        if token[:k] in known:
            yield token[k:], token[:k]
        if token[-k:] in known:
            yield token[:-k], token[-k:]
    if len(token) > MIN_FAMILY:
        yield token[1:], token[0]
        yield token[:-1], token[-1]
    if len(token) >= 8:
        yield token[3:], token[:3]
        yield token[2:], token[:2]


def _hint(family: str, hint: str, lexicon: Lexicon) -> str:
    """What is known of a given name beside a family name, with the full names it stands for if it is a form of some."""
    return f"{family}={hint}={'|'.join(sorted(lexicon.get(hint, ())))}"


def parse(name: str | None, email: str | None, lexicon: Lexicon) -> dict:
    """A row's reading: ``kind``, ``family`` names, ``given`` full names and their ``forms``, ``hints``, ``mail``, ``tokens``.

    ``whole`` are the family names as typed, ``known`` says that the given names are in the lexicon, ``personal`` that the
    mailbox is made of the family name and the beginning of the given name.
    """
    row = _parts(name, email)
    typed, words, mail, local, label, parts = row
    plain = {"given": [], "forms": [], "known": False, "hints": [], "whole": [], "mail": mail, "personal": False, "typed": typed, "sure": True}
    if "bot" in words or typed.endswith("-bot"):
        return plain | {"kind": "bot", "family": [typed], "tokens": words}
    if "@" not in typed and len(words) > 2 and UNITS & set(words):
        rest = [w for w in words if w not in UNITS | FILLERS]
        return plain | {"kind": "org", "family": sorted(rest), "tokens": [*rest, label]}

    given, family = "", []
    if "@" in typed:
        words = []
    elif "," in typed:
        left, right = typed.split(",", 1)
        family = [_letters(p) for p in left.split("-")]
        right_words = re.findall(r"[^\W\d_]+", right)
        given = right_words[0] if right_words else ""
    else:
        spaced = _spaced(typed)
        if len(spaced) >= 2:
            first, last = _letters(spaced[0]), spaced[-1]
            plain_last = _letters(last)
            if first not in lexicon and plain_last in lexicon and len(first) > 2:
                first, last = plain_last, spaced[0]
            given, family = first, [_letters(p) for p in last.split("-")]
        elif spaced:
            word = spaced[0]
            pieces = [p for p in re.split(r"[._-]", word) if p]
            if word in lexicon:
                given = word
            else:
                parts = [*pieces, *parts] if len(pieces) == 1 else [*parts, *[p for p in pieces if p not in parts]]
    family = [f for f in family if len(f) > 1]
    whole = list(family)
    hints: set[str] = set()
    full: set[str] = set()
    if given:
        if given in lexicon:
            full |= set(lexicon[given])
        elif len(given) <= 2:
            hints.add(given[0])
        else:
            full.add(given)
    known = {*lexicon, *([given] if len(given) > 2 else [])}

    readings: set[tuple[str, str]] = set()
    for token in {*parts, label}:
        readings |= set(_trimmed(token, known))
    confirmed, related, personal = False, False, False
    if family:
        main = family[0]
        best = max(readings, key=lambda r: (ratio(main, r[0]), r[1] in lexicon, len(r[1]), r), default=("", ""))
        if best[0] and ratio(main, best[0]) >= 0.8:
            related = True
            confirmed = best[0] == main
            own = local[: local.find(best[0])] + local[local.find(best[0]) + len(best[0]) :] if best[0] in local else ""
            personal = bool(_letters(own)) and (not given or _letters(own)[0] == given[0])
            rest = {best[1]} if best[1] else set()
            rest |= {p for p in parts if p != best[0] and not p.endswith(best[0]) and len(p) < 15}
            near = {r[0] for r in readings if ratio(main, r[0]) == ratio(main, best[0])}
            # a second family name is shared by people of different families
            family, whole = [main, *(n for n in sorted(near) if n != main)], [main]
            for r in sorted(rest):
                if r in lexicon and given and given not in lexicon and len(given) > 2 and not any(ratio(given, c) >= 0.7 for c in (*lexicon[r], r)):
                    # an unknown form, beside the name it stands for in the address
                    full |= set(lexicon[r]) if len(r) > 3 else set()
                elif r in lexicon and (not full or full & set(lexicon[r]) or any(g not in lexicon and ratio(g, c) >= 0.7 for g in full for c in (*lexicon[r], r))):
                    if not hints or any(c.startswith(h) for h in hints for c in (*lexicon[r], r)):
                        full = (full & set(lexicon[r])) or set(lexicon[r])
                        if len(full) > 1 and r in full:
                            full = {r}
                elif not full and len(r) <= 3 and (not hints or r[0] in hints or not given):
                    hints.add(r)
    else:
        owned: set[tuple[str, str]] = set()
        single = [p for p in parts if len(p) >= MIN_FAMILY or p in lexicon]
        names = [p for p in single if p in lexicon]
        others = [p for p in single if p not in lexicon]
        if others and (names or any(len(p) == 1 for p in parts)):
            for o in others:
                owned |= {(o, n) for n in (names or [p for p in parts if len(p) == 1])}
        elif names and not others and label:
            owned |= {(label, n) for n in names}
        else:
            for o in others:
                owned |= {r for r in _trimmed(o, known) if r[1]}
        if given:
            starts = {given[0], *(c[0] for c in full)}
            owned = {r for r in owned if r[1] and (r[1] in lexicon and set(lexicon[r[1]]) & full or r[1][0] in starts)} or {
                (o, given) for o in others
            }
        related = bool(owned)
        return {
            "kind": "login", "family": sorted({r[0] for r in owned}), "given": sorted(full), "forms": [], "known": False,
            "hints": sorted({_hint(f, h, lexicon) for f, h in owned}), "whole": [], "mail": mail if related or local in typed else "", "personal": False,
            "tokens": sorted({*parts, *(r[0] for r in owned), label}), "typed": typed, "sure": False,
        }
    forms = {f for r in ({given} | rest if related else {given}) for y, x in lexicon.get(r, {}).items() if y in full for f in x}
    return {
        "kind": "person", "family": family, "given": sorted(full), "forms": sorted(forms | full), "known": bool(forms),
        "hints": sorted(_hint("", h, lexicon) for h in hints), "whole": whole, "mail": mail if related else "", "personal": personal,
        "tokens": sorted({*family, *parts, label} if related else set(family)), "typed": typed, "sure": confirmed,
    }


def _same_given(a: list[str], b: list[str], known: bool) -> bool | None:
    """Whether full given names agree; None if either is not given. Two known names agree only if they are the same."""
    if not a or not b:
        return None
    if set(a) & set(b):
        return True
    return not known and any(ratio(x, y) >= 0.75 for x in a for y in b)


def _fits(hint: str, person: dict) -> str:
    """``strong`` if at least three first letters fit a given name or a form of it, ``weak`` for an initial."""
    _, word, full = hint.split("=")
    if full:
        return "strong" if set(full.split("|")) & set(person["given"]) else ""
    if any(f.startswith(word) for f in person["forms"]):
        return "strong" if len(word) >= 3 else "weak"
    return ""


def compare(a: dict, b: dict) -> str:
    """``strong``, ``weak`` (an initial fits) or nothing."""
    if a["kind"] in ("org", "bot") or b["kind"] in ("org", "bot"):
        if a["kind"] != b["kind"]:
            return ""
        if a["kind"] == "bot":
            return "strong" if a["typed"] == b["typed"] or a["mail"] == b["mail"] and ratio(a["typed"], b["typed"]) >= 0.8 else ""
        x, y = list(a["family"]), list(b["family"])
        if len(x) != len(y):
            return ""
        for word in x:
            near = max(y, key=lambda w: ratio(word, w))
            if not (word == near or len(word) > 3 and one_slip(word, near)):
                return ""
            y.remove(near)
        return "strong"
    same = _same_given(a["given"], b["given"], a["known"] and b["known"])
    if a["mail"] and a["mail"] == b["mail"] and same is not False:
        return "strong"
    if a["kind"] == "login" and b["kind"] == "login":
        shared = set(a["hints"]) & set(b["hints"])
        return "strong" if a["typed"] == b["typed"] and shared and len(a["typed"]) > 6 else ""
    if b["kind"] == "login":
        a, b = b, a
    if a["kind"] == "login":
        best = ""
        for option in a["hints"]:
            family, hint, _ = option.split("=")
            if family not in b["family"] or len(family) < MIN_FAMILY or not hint:
                continue
            if b["given"]:
                fit = _fits(option, b)
            else:
                fit = "weak" if any(hint[0] == h[1] for h in b["hints"]) else ""
            best = fit if fit == "strong" or not best else best
        return best
    family = set(a["family"]) & set(b["family"])
    slip = False
    if not family and same:
        # one slip of the pen, in a name that its own address does not confirm
        slip = any(one_slip(x, y) for x in a["whole"] for y in b["whole"] if min(len(x), len(y)) >= 6)
        slip = slip and not (a["sure"] and b["sure"])
    if not family and not slip:
        return ""
    if same is not None:
        return "strong" if same else ""
    if a["given"] or b["given"]:
        full, part = (a, b) if a["given"] else (b, a)
        fits = [_fits(h, full) for h in part["hints"]]
        return "strong" if "strong" in fits else "weak" if fits and all(fits) else ""
    return "weak" if {h[1] for h in a["hints"]} & {h[1] for h in b["hints"]} else ""


READING = (
    "kind string, family array<string>, given array<string>, forms array<string>, known boolean, hints array<string>, "
    "whole array<string>, starts array<string>, mail string, personal boolean, tokens array<string>, typed string, sure boolean, keys array<string>"
)
#: what ``compare`` looks at; a mailbox counts here for automatic accounts only, those of people are linked by themselves
SIDE = ("kind", "family", "given", "forms", "known", "hints", "whole", "starts", "mail", "typed", "sure")
#: what is looked at inside a block, before anything else of a pair is fetched
FIRST = ("kind", "given", "starts", "typed")


def _shorter(word: str) -> set[str]:
    """The word, and the word less one letter: two words share one of these exactly if ``one_slip`` holds."""
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}


def block_keys(row: dict) -> list[str]:
    """Keys of a reading; two readings that ``compare`` accepts share one, save for slips in a family name (``_slips``)."""
    if row["kind"] == "bot":
        return [f"b:{row['typed']}", f"m:{row['mail']}"]
    if row["kind"] == "org":
        n = len(row["family"])
        return sorted({f"o:{n}:{k}" for w in row["family"] for k in (_shorter(w) if len(w) > 2 else {w})}) or [f"o:0:{t}" for t in row["tokens"]]
    keys = [f"f:{f}" for f in row["family"]]
    return [*keys, f"t:{row['typed']}"] if row["kind"] == "login" and row["typed"] else keys


def _shown(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [e for n, m in zip(batch["name"], batch["email"], strict=True) for e in evidence(n, m)]
        yield pd.DataFrame(rows, columns=["kind", "word", "other", "beside"])


def _without_slips(names: DataFrame) -> DataFrame:
    """``names`` (``word, given``) less those that a slip of the pen parts from a name far more frequent."""
    less = F.expr("array_union(array(word), transform(sequence(1, length(word)), i -> concat(substring(word, 1, i - 1), substring(word, i + 1))))")
    keyed = names.select("word", "given", F.explode(less).alias("less"))
    met = keyed.toDF("slip", "few", "less").join(keyed.toDF("name", "many", "less").hint("merge"), "less").where(F.col("few") < SLIPS * F.col("many"))
    return names.join(met.select(F.col("slip").alias("word")).distinct().hint("merge"), "word", "left_anti")


def _together(beside: DataFrame, names: DataFrame) -> DataFrame:
    """``short, full`` (one of ``names``): given names that ``TOGETHER`` of the families (``word, family``) of the rarer one share.

    Every family counts. In families of at most ``MOST_GIVEN`` given names two that meet are counted as they are, if not
    one partner of a name is expected to be met as often by chance. A large family has many pairs by chance, so over all
    families it is the surplus beyond chance that has to make up the share, and it must be so large that not one pair of
    the table is expected to reach it; there, chance is taken times how much more often the short name meets others than
    by chance. Chance is what the numbers of families of both and the sizes of these families give. Families of many
    given names are worked off part by part.
    """
    sizes = cut(beside.groupBy("family").agg(F.count(F.lit(1)).alias("n")))
    # the family of one given name has no pair
    informed = cut(attach(beside, sizes.where("n > 1"), "family", "n", beside.count()))
    stats = informed.groupBy("word").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("n") - 1).alias("load"), F.count_if(F.col("n") <= MOST_GIVEN).alias("few")
    )
    stats = cut(stats)
    words, rows = stats.count(), informed.count()
    if not rows:
        return stats.select(F.col("word").alias("short"), F.col("word").alias("full"))
    # what meets in SHOWN families is in as many
    often = cut(informed.join(stats.where(F.col("n") >= SHOWN).select("word").hint("merge"), "word"))
    fulls = often.join(names.select("word").hint("merge"), "word", "left_semi").select(F.col("word").alias("full"), "family")
    met = cells(often.toDF("short", "family", "size"), fulls, "family", large_blocks(often, "family", "word"), "short", "full")
    met = met.where("length(short) < length(full)").groupBy("short", "full")
    met = met.agg(F.count(F.lit(1)).alias("both"), F.count_if(F.col("size") <= MOST_GIVEN).alias("near"))
    side = {s: stats.toDF(s, f"n_{s}", f"load_{s}", f"few_{s}").hint("merge") for s in ("short", "full")}
    met = met.join(side["short"], "short").join(side["full"], "full")
    met = cut(met.withColumn("chance", F.greatest(F.col("load_short") * F.col("n_full"), F.col("load_full") * F.col("n_short")) / rows))
    lift = met.groupBy("short").agg(F.greatest(F.sum("both") / F.sum("chance"), F.lit(1.0)).alias("lift"))
    met = met.where(F.col("both") >= SHOWN).join(lift.hint("merge"), "short").withColumn("raised", F.col("chance") * F.col("lift"))
    # Chernoff's bound of a Poisson variable's tail, for every partner of a word and for every pair of words
    surprise = {c: F.when(F.col("both") > F.col(c), F.col("both") * (F.ln(F.col("both") / F.col(c)) - 1) + F.col(c)).otherwise(0.0) for c in ("chance", "raised")}
    sure = (F.col("both") - F.col("raised") >= TOGETHER * F.least("n_short", "n_full")) & (surprise["raised"] >= 2 * math.log(words))
    plain = (F.col("near") >= SHOWN) & (F.col("near") >= TOGETHER * F.least("few_short", "few_full")) & (surprise["chance"] >= math.log(words))
    return met.where(plain | sure).select("short", "full")


def lexicon(source: DataFrame) -> DataFrame:
    """``word, fulls`` (full name -> all its forms) of the given names that the table (``name, email``) shows.

    A word is a given name if it is one beside ``SHOWN`` different family names at least, and more often than it is a
    family name. Two names are forms of one if addresses say so in ``SHOWN`` families, or if ``TOGETHER`` of the
    families of the rarer one have the other as well (``_together``); of two forms the longer is the full name. What is
    shuffled are the different (word, name beside it), and pairs of these inside a family.
    """
    shown = cut(source.mapInPandas(_shown, "kind string, word string, other string, beside string").distinct())
    votes = shown.where("kind in ('given', 'family')").groupBy("word").agg(
        F.count_if(F.col("kind") == "given").alias("given"), F.count_if(F.col("kind") == "family").alias("family")
    )
    names = cut(_without_slips(cut(votes.where((F.col("given") >= SHOWN) & (F.col("given") > F.col("family"))).select("word", "given"))))
    written = shown.where("kind = 'forms'").groupBy("word", "other").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SHOWN)
    written = written.toDF("short", "full", "n").unionByName(written.toDF("full", "short", "n")).where("length(short) <= length(full)").select("short", "full")
    beside = shown.where("kind = 'beside'").select("word", F.col("beside").alias("family"))
    pairs = written.unionByName(_together(beside, names))
    pairs = pairs.distinct().join(names.toDF("full", "n_full").hint("merge"), "full").join(names.toDF("short", "n_short").hint("merge"), "short", "left")
    # of two names of one length the more frequent is the full one
    pairs = pairs.where("length(short) < length(full) or coalesce(n_short, 0) < n_full").select("full", "short")
    # a form of a form is one of the full name: the longest is reached in a step or two
    up = pairs.toDF("middle", "short").join(pairs.toDF("full", "middle").hint("merge"), "middle").select("full", "short")
    forms = cut(pairs.select("full", "short").unionByName(up).distinct())
    short = forms.select(F.col("short").alias("word")).distinct()
    tops = names.select("word").join(short.hint("merge"), "word", "left_anti").select(F.col("word").alias("full"))
    of = tops.select("full", F.col("full").alias("word")).unionByName(forms.join(tops.hint("merge"), "full").select("full", F.col("short").alias("word")))
    of = cut(of.distinct())
    every = of.groupBy("full").agg(F.array_sort(F.collect_set("word")).alias("forms"))
    return of.join(every.hint("merge"), "full").groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("full", "forms"))).alias("fulls"))


def _probed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch.assign(words=[probes(n, e) for n, e in zip(batch["name"], batch["email"], strict=True)])


def _with_names(source: DataFrame, names: DataFrame) -> DataFrame:
    """``source`` (``id, name, email``) with ``found``: what the lexicon has on the strings of each row."""
    kind = source.schema["id"].dataType.simpleString()
    once = source.distinct()
    rows = cut(once.mapInPandas(_probed, f"id {kind}, name string, email string, words array<string>").withColumn("row", F.monotonically_increasing_id()))
    loose = rows.select("row", F.explode("words").alias("word"))
    near = small_side(names)
    if near is names:
        # a string that very many rows have meets one of several copies of the lexicon
        loose = loose.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)))
        near = names.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))).hint("merge")
        found = loose.join(near, ["word", "salt"])
    else:
        found = loose.join(near, "word")
    found = found.groupBy("row").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("word", "fulls")))).alias("found"))
    return rows.select("row", "id", "name", "email").join(found.hint("merge"), "row", "left").select("id", "name", "email", "found")


def starts(row: dict) -> list[str]:
    """The first letters that the given name of a reading can have."""
    words = [*row["forms"], *row["given"], *(w for h in row["hints"] for w in (h.split("=")[1], *h.split("=")[2].split("|")))]
    return sorted({w[0] for w in words if w})


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        parsed = [parse(n, e, json.loads(f) if f else {}) for n, e, f in zip(batch["name"], batch["email"], batch["found"], strict=True)]
        rows = pd.DataFrame([{**r, "starts": starts(r), "keys": block_keys(r)} for r in parsed])
        if len(rows):
            yield pd.concat([batch[["id"]].reset_index(drop=True), rows], axis=1)


@lru_cache(maxsize=50_000)
def _side(body: str) -> dict:
    return json.loads(body)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with both readings as text, each read once; those that ``compare`` accepts."""
    for batch in batches:
        sides = [(_side(x), _side(y)) for x, y in zip(batch.column("body_a").to_pylist(), batch.column("body_b").to_pylist(), strict=True)]
        found = [compare(x, y) for x, y in sides]
        kept = [i for i, match in enumerate(found) if match]
        columns = [batch.column(c).take(pa.array(kept, pa.int64())) for c in ("a", "b", "least_a", "least_b")]
        columns += [pa.array([found[i] for i in kept], pa.string()), *(pa.array([bool(sides[i][k]["given"]) for i in kept], pa.bool_()) for k in (0, 1))]
        yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "least_a", "least_b", "match", "full_a", "full_b"])


def _readings(read: DataFrame) -> DataFrame:
    """``id, reading`` and what is compared: rows that read alike have one number ``reading``, their count ``n`` and their ``least`` id."""
    plain = read.withColumn("mail", F.when(F.col("kind") == "bot", F.col("mail")).otherwise(F.lit("")))
    plain = plain.withColumn("typed", F.when(F.col("kind").isin("bot", "login"), F.col("typed")).otherwise(F.lit("")))
    plain = plain.withColumn("alike", F.to_json(F.struct(*SIDE, "keys")))
    once = plain.groupBy("alike").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    once = cut(once.withColumn("reading", F.monotonically_increasing_id()))
    return attach(plain.select("id", "alike", *SIDE, "keys"), once, "alike", "n", plain.count()).drop("alike")


def _slips(readings: DataFrame) -> DataFrame:
    """``one, other``: family names (``one < other``) that a slip of the pen parts, found by the names less one letter."""
    name = readings.where("kind = 'person' and size(given) > 0").select(F.explode("whole").alias("name"))
    name = name.where(F.length("name") >= 6).distinct()
    less = F.expr("explode(array_distinct(transform(sequence(0, length(name)), i -> concat(substring(name, 1, i - 1), substring(name, i + 1)))))")
    less = cut(name.select("name", less.alias("less")).unionByName(name.select("name", F.col("name").alias("less"))).distinct())
    return less.toDF("one", "less").join(less.toDF("other", "less"), "less").where("one < other").select("one", "other").distinct()


def _pairs(readings: DataFrame) -> DataFrame:
    """Pairs of readings (a < b, or a = b of several rows) that ``compare`` can accept, with all that it looks at.

    No block is left out for its size: a large one is cut into parts, and every part meets every other. What can be
    told from given names and first letters is decided there, so only pairs that may fit leave a block.
    """
    own = readings.where("id = least").select("reading", "least", "n", *FIRST, "keys", "whole", F.to_json(F.struct(*SIDE)).alias("body"))
    own = cut(own.dropDuplicates(["reading"]))
    index = cut(own.select("reading", *FIRST, F.explode(F.array_distinct("keys")).alias("block")))
    met = block_pairs(index, "block", "reading", large_blocks(index, "block", "reading", MOST_ROWS), FIRST)
    slip = cut(_slips(readings).withColumn("block", F.concat(F.lit("s:"), "one", F.lit("|"), "other")))
    first = own.where("kind = 'person' and size(given) > 0").select("reading", *FIRST, F.explode(F.array_distinct("whole")).alias("name"))
    side = {s: first.join(slip.select("block", F.col(c).alias("name")).hint("merge"), "name") for s, c in (("a", "one"), ("b", "other"))}
    side = {s: rows.select("block", F.col("reading").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in FIRST)) for s, rows in side.items()}
    large = large_blocks(side["a"].select("block", "a").unionByName(side["b"].select("block", F.col("b").alias("a"))), "block", "a", MOST_ROWS)
    met = met.where(_MAY_FIT).select("a", "b").unionByName(
        cells(side["a"], side["b"], "block", large, "a", "b").where(_MAY_FIT).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    )
    alone = own.where("n > 1").select(F.col("reading").alias("a"), F.col("reading").alias("b"))
    pairs = cut(met.where("a <> b").distinct().unionByName(alone))
    sides = {s: own.select(F.col("reading").alias(s), F.col("least").alias(f"least_{s}"), F.col("body").alias(f"body_{s}")).hint("merge") for s in "ab"}
    return pairs.join(sides["a"], "a").join(sides["b"], "b")


#: what leaves a block: given names near enough for any ratio of 0.75, first letters that can be the same, equal logins
_MAY_FIT = """case
  when kind_a in ('org', 'bot') or kind_b in ('org', 'bot') then kind_a = kind_b
  when kind_a = 'login' and kind_b = 'login' then typed_a = typed_b
  when kind_a = 'person' and kind_b = 'person' and size(given_a) > 0 and size(given_b) > 0
  then exists(given_a, x -> exists(given_b, y -> levenshtein(x, y) <= 0.25 * (length(x) + length(y))))
  else arrays_overlap(starts_a, starts_b) end"""


def _boxes(read: DataFrame) -> DataFrame:
    """Links of rows that share a mailbox which fits their names, unless their given names disagree.

    Names beside a personal mailbox are forms of one name, however different they look.
    """
    boxed = read.where("mail <> '' and kind in ('person', 'login')").select("id", "mail", "given", (F.col("known") & ~F.col("personal")).alias("known"), "personal")
    box = cut(boxed.groupBy("mail", "given", "known", "personal").agg(F.min("id").alias("least")))
    stars = boxed.join(box.hint("merge"), ["mail", "given", "known", "personal"]).where("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b"))
    # the different given names at one mailbox
    met = box.toDF("mail", "g", "k", "p", "a").join(box.toDF("mail", "h", "l", "q", "b").hint("merge"), "mail").where("a < b")
    agree = F.udf(lambda g, h, known: _same_given(list(g), list(h), known) is not False, "boolean")
    return stars.unionByName(met.where((F.col("p") | F.col("q")) | agree("g", "h", F.col("k") & F.col("l"))).select("a", "b"))


def link_names(df: DataFrame, key: str, name: str, email: str) -> DataFrame:
    """``key, entity`` of every row that belongs with another one.

    Names and addresses may be null or empty; a row that has neither is linked to none. A mailbox links rows only if
    it fits their names, so a team's mailbox makes no two people the same. Repeated keys are one node. Other columns
    are not read.
    """
    source = df.select(F.col(key).alias("id"), F.col(name).cast("string").alias("name"), F.col(email).cast("string").alias("email"))
    kind = source.schema["id"].dataType.simpleString()
    source = source.where("id is not null")
    read = cut(_with_names(source, cut(lexicon(source))).mapInPandas(_read, f"id {kind}, {READING}"))
    readings = cut(_readings(read))
    rows = readings.select("id", "reading", "least")
    boxes = cut(_boxes(read).distinct())
    out = f"a long, b long, least_a {kind}, least_b {kind}, match string, full_a boolean, full_b boolean"
    compared = cut(_pairs(readings).mapInArrow(_compared, out))
    strong = compared.where("match = 'strong'")
    # rows of a reading that is linked at all belong together, so one of them stands for all
    sure = cut(_all_rows(strong, rows).unionByName(boxes).distinct())
    weak = compared.where("match = 'weak'").drop("match")
    ways = weak.unionByName(weak.toDF("b", "a", "least_b", "least_a", "full_b", "full_a"))
    to_full = ways.where("not full_a and full_b").select("a", "b", "least_b").distinct()
    # the given names of one entity can be written in several ways; what counts is how many entities fit an initial
    entity = components(sure, "a", "b")
    who = rows.join(entity, F.col("id") == F.col("node"), "left").withColumn("who", F.coalesce("component", "id"))
    who = who.groupBy("reading").agg(F.min("who").alias("low"), F.max("who").alias("high"))
    fitting = to_full.join(who, F.col("b") == F.col("reading"))
    single = cut(fitting.groupBy("a").agg((F.min("low") == F.max("high")).alias("one"), F.min("least_b").alias("b")))
    alone = ways.where("not full_a and not full_b").join(single.select(F.col("a").alias("s")), F.col("a") == F.col("s"), "left_anti")
    alone = alone.join(single.select(F.col("a").alias("s")), F.col("b") == F.col("s"), "left_anti")
    # rows known by an initial that an address ties to a full name need no guess
    guessed = single.where("one").join(rows, F.col("a") == F.col("reading")).select(F.col("id").alias("a"), "b")
    guessed = guessed.join(_tied(strong, read, rows), F.col("a") == F.col("tied"), "left_anti")
    links = sure.unionByName(guessed).unionByName(_all_rows(alone, rows))
    return components(links, "a", "b").select(F.col("node").alias(key), F.col("component").alias("entity"))


def _all_rows(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Links of the least rows of readings, and of every row of these readings to its least one."""
    linked = pairs.select(F.col("a").alias("reading")).unionByName(pairs.select(F.col("b").alias("reading"))).distinct()
    stars = rows.join(linked, "reading").where("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b"))
    return pairs.select(F.col("least_a").alias("a"), F.col("least_b").alias("b")).unionByName(stars)


def _tied(strong: DataFrame, read: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows without a full given name that have a strong link, by name or mailbox, to one with a full given name."""
    ways = strong.select("a", "full_b").unionByName(strong.select(F.col("b").alias("a"), F.col("full_a").alias("full_b"))).where("full_b")
    by_name = rows.join(ways, F.col("reading") == F.col("a"), "left_semi").select(F.col("id").alias("tied"))
    boxed = read.where("mail <> '' and kind in ('person', 'login')")
    full = boxed.where("size(given) > 0").select("mail").distinct()
    by_box = boxed.where("size(given) = 0").join(full, "mail", "left_semi").select(F.col("id").alias("tied"))
    return by_name.unionByName(by_box).distinct()


def entity_pairs(linked: DataFrame, key: str) -> DataFrame:
    """All pairs of rows of one entity, ``key_a < key_b``."""
    left, right = linked.select("entity", F.col(key).alias(f"{key}_a")), linked.select("entity", F.col(key).alias(f"{key}_b"))
    return left.join(right, "entity").where(F.col(f"{key}_a") < F.col(f"{key}_b")).select(f"{key}_a", f"{key}_b")
