"""Operators 11 to 13 against brute force, and on odd rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

pytest.importorskip("lodestar.llm")
from lodestar.llm import anchors, collocations, fill_middle  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string"
LONG = " ".join(random.Random(3).choices(["alpha", "beta", "gamma", "delta,", "EPSILON"], k=200_000))


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, f"s{i}") for i, t, lang in rows], DOCS)


# Fill-in-middle


def plain_fim(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    lo, hi = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    out = f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < 20 else f"<P>{p}<S>{s}<M>{m}"
    return len(units), "spm" if out.startswith("<S>") else "psm", len(p), len(m), out


def test_fill_in_middle_against_units_by_pattern(spark):
    draw = random.Random(1)
    texts = ["".join(draw.choices("ab Z9\n<>PSMé\U0001f600\u0000_", k=draw.randrange(60))) for _ in range(400)]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(None, "no id here", "en"), (7, None, None), (8, "", "en"), (9, "a<S>b", "en"), (10, LONG, "en"), (11, "<<S", "en")]
    made = fill_middle.fill_in_middle(table(spark, rows))
    assert made.columns == ["doc_id", "text", "lang", "source", "fim_units", "fim_form", "fim_prefix", "fim_middle", "fim_output"]
    got = sorted(tuple(map(str, r)) for r in fill_middle.digest(made).collect())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(i, *plain_fim(i, t)[:4], sha(plain_fim(i, t)[4]), sha(t or "")) for i, t, _ in rows]
    assert got == sorted(tuple(map(str, w)) for w in want)
    assert {"plain", "psm", "spm"} == {w[2] for w in want}


def test_fill_in_middle_keeps_rows_and_columns_of_any_name(spark):
    docs = table(spark, [(1, "one two", "en"), (1, "one two", "en"), (None, None, None)]).withColumns({c: F.lit(c) for c in ("own", "fim_text", "h1", "h4", "n", "form", "fim_form")})
    out = fill_middle.fill_in_middle(docs)
    rows = out.collect()
    assert len(rows) == 3 and all(r[c] == c for r in rows for c in ("own", "fim_text", "h1", "h4", "n", "form"))
    assert len({(r.fim_form, r.fim_output) for r in rows if r.doc_id == 1}) == 1
    assert fill_middle.fill_in_middle(docs.limit(0)).count() == 0
    assert fill_middle.digest(fill_middle.fill_in_middle(docs, rate=0)).where("form <> 'plain'").count() == 0


# Anchors


def plain_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in text or ""))
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) > 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(items, linked):
    root = {i: i for i in items}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    ordered = sorted(items)
    for k, a in enumerate(ordered):
        for b in ordered[k + 1 :]:
            if linked(a, b):
                root[find(b)] = find(a)
    return {i: find(i) for i in items}


def test_every_anchor_choice_covers_the_threshold():
    draw = np.random.default_rng(4)
    x = draw.integers(0, 1 << 64, 400, dtype=np.uint64)
    y = x.copy()
    for i in range(len(y)):
        for b in draw.choice(64, i % 5, replace=False):
            y[i] ^= np.uint64(1 << int(b))
    for parts in (1, 2, 3):
        of = defaultdict(set)
        for i, key in zip(*anchors.anchors(x, parts), strict=True):
            of[i].add(key)
        assert {i for i, key in zip(*anchors.anchors(y, parts), strict=True) if key in of[i]} == set(range(len(x)))


def test_near_duplicates_against_all_pairs(spark):
    draw = random.Random(5)
    words = ["".join(draw.choices("abcdefghÉé", k=4)) for _ in range(300)]
    rows = []
    for i in range(60):
        text = draw.choices(words, k=draw.choice([1, 3, 4, 5, 80, 400]))
        rows.append((3 * i, " ".join(text), "en"))
        for j in (1, 2):
            own = list(text)
            own[draw.randrange(len(own))] = draw.choice(words)
            rows.append((3 * i + j, "\t".join(own).upper().replace("É", "é") if j == 1 else " ".join(own), "en"))
    rows += [(900, None, None), (901, " \n ", "en"), (None, rows[0][1], "en"), (5, rows[0][1], "en"), (902, LONG, "en"), (903, LONG + " end", "en")]
    got = anchors.near_duplicates(table(spark, rows)).collect()
    of = {t: plain_simhash(t) for _, t, _ in rows}
    root = plain_components(set(of.values()), lambda a, b: (a ^ b).bit_count() <= 4)
    least = defaultdict(list)
    for i, t, _ in rows:
        if i is not None:
            least[root[of[t]]].append(i)
    want = sorted((str(i), f"{of[t]:016x}", min(least[root[of[t]]])) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == want
    assert len(set(root.values())) < len(root)


@pytest.mark.parametrize("parts", [1, 2, 3])
def test_wide_anchors_lose_no_link(spark, monkeypatch, parts):
    monkeypatch.setattr(anchors, "CHUNK", 8)
    draw = random.Random(6 + parts)
    fps = set()
    for _ in range(4):
        centre = draw.getrandbits(64)
        for _ in range(60 if parts < 3 else 20):
            fps.add(centre ^ sum(1 << b for b in draw.sample(range(12), draw.randrange(7))))
    fps |= {draw.getrandbits(64) for _ in range(50)}
    signed = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    got = {r.node % (1 << 64): r.component for r in anchors.fingerprint_classes(signed, 4, parts).collect()}
    root = plain_components(fps, lambda a, b: (a ^ b).bit_count() <= 4)
    groups, want = defaultdict(set), defaultdict(set)
    for f in fps:
        groups[got.get(f, f)].add(f)
        want[root[f]].add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_near_duplicates_of_nothing_and_of_clashing_columns(spark):
    docs = table(spark, [(1, "a b c d e", "en"), (2, "a b c d e", "en")]).withColumns({c: F.lit(c) for c in ("fp", "least", "component", "n", "first")})
    assert sorted(tuple(r)[::2] for r in anchors.near_duplicates(docs).collect()) == [(1, 1), (2, 1)]
    assert anchors.near_duplicates(docs.limit(0)).count() == 0


# Collocations


def plain_collocations(rows, least, longest, top):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        good = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in good.items():
            score, cut = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            if not any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in good.items()):
                kept.append((-score, -a, " ".join(p).encode(), counts[p[:cut]], counts[p[cut:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def mined(docs, **options):
    return sorted(tuple(r) for r in collocations.collocations(docs, buckets=1 << 16, **options).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_collocations_against_all_phrases(spark, monkeypatch):
    monkeypatch.setattr(collocations, "WORDS", 300)
    draw = random.Random(8)
    words = ["the", "Of", "new", "york", "café", "Été", "x-y", "don't", "a", "\u0000"]
    fixed = ["New York City hall opens", "of the", "té té té"]
    rows = []
    for i in range(150):
        parts = [draw.choice(fixed) if draw.random() < 0.3 else " ".join(draw.choices(words, k=draw.randrange(1, 7))) for _ in range(draw.randrange(8))]
        rows.append((i, draw.choice([", ", "\n", "\t", " ", "? !"]).join(parts), draw.choice(["en", "fr", None, ""])))
    rows += [(200, None, "en"), (201, "", "en"), (202, ".,;", "xx"), (203, LONG, "long"), (0, rows[0][1], rows[0][2])]
    for least, longest, top in ((5, 5, 2000), (3, 3, 7), (5, 2, 2000)):
        want = plain_collocations(rows, least, longest, top)
        assert mined(table(spark, rows), least=least, longest=longest, top=top) == want and len(want) > 20


def test_collocations_need_no_bitmap_to_be_right(spark):
    rows = [(i, f"red hot w{i % 3} poker", "en") for i in range(30)]
    docs = table(spark, rows).withColumns({c: F.lit(c) for c in ("phrase", "n", "score", "block")})
    assert mined(docs, least=10, longest=5, top=None) == plain_collocations(rows, 10, 5, 10**6)
    assert mined(docs, least=31, longest=5, top=5) == [] == mined(docs.limit(0), least=1, longest=2, top=5)


def test_frequent_counts_beyond_a_byte(spark):
    rows = [(i, "big deal here", "en") for i in range(700)]
    assert mined(table(spark, rows), least=600, longest=3, top=5) == plain_collocations(rows, 600, 3, 5) != []


def test_scores_beyond_64_bits_are_exact(spark):
    a, n = 10**9, 10**13
    expr = "(1000 * cast(a AS decimal(15, 0)) * cast(n AS decimal(18, 0))) div (cast(l AS decimal(18, 0)) * cast(r AS decimal(18, 0)))"
    row = spark.createDataFrame([(a, n, a + 7, a + 11)], "a long, n long, l long, r long").select(F.expr(expr).alias("s")).first()
    assert row.s == 1000 * a * n // ((a + 7) * (a + 11))
