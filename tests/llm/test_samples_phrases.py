"""Fill-in-middle, collocations and relative parsing against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from estate.llm import collocations, count_transducer, fill_middle, queries, relative_parse
from tools.check import compare, duck

from .conftest import prose

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_fill_middle", "op12_phrase_mining", "op13_substring_dedup"])
def test_query_matches_sql(spark, name):
    ok, note = compare(queries.QUERIES[name](spark, SF_DIR), duck(SF_DIR), queries.ORACLE[name])
    assert ok, note
    assert "TYPES" not in note, note


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# Fill in middle


def brute_fim(key, text, marks=("<P>", "<S>", "<M>"), rate=100, spm=50, seed=7):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(h[i : i + 8], 16) for i in range(0, 32, 8)]
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    one, two = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(units[a:b]) for a, b in ((0, one), (one, two), (two, None)))
    if not text or any(x in text for x in marks) or h[2] % 100 >= rate:
        return key, len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return key, len(units), "spm", len(p), len(m), marks[1] + s + marks[0] + p + marks[2] + m
    return key, len(units), "psm", len(p), len(m), marks[0] + p + marks[1] + s + marks[2] + m


def test_fim_matches_brute_force_and_goes_back(docs):
    rng = random.Random(3)
    parts = ["a", "\n", "<", "S>", "é", "\U0001f600", "\r", " ", "<P", "\n\n"]
    texts = ["", None, "\n", "<S>", "x<M>y\n"] + ["".join(rng.choices(parts, k=rng.randrange(30))) for _ in range(400)]
    for more in ({}, {"rate": 50, "spm": 10, "seed": 3}, {"marks": ("[pre]", "[suf]", "[mid]")}, {"rate": 0}):
        out = fill_middle.fill_in_middle(docs(texts), **more)
        assert rows_of(out) == sorted((brute_fim(i, t, **more) for i, t in enumerate(texts)), key=str)
        back = fill_middle.restore(out, more.get("marks", fill_middle.MARKS))
        assert {r.doc_id: r.restored for r in back.collect()} == {i: t or "" for i, t in enumerate(texts)}


def test_fim_handles_awkward_rows(awkward):
    df, rows = awkward
    out = fill_middle.fill_in_middle(df)
    assert rows_of(out) == sorted((brute_fim(r[0], r[1]) for r in rows), key=str)
    kept = fill_middle.restore(out.withColumn("restored_from", F.lit(1)))
    assert sorted(r.restored for r in kept.collect()) == sorted(r[1] or "" for r in rows)


def test_fim_of_nothing_and_of_nulls(spark, nothing):
    out = fill_middle.fill_in_middle(nothing)
    assert out.count() == 0 and fill_middle.restore(out).count() == 0
    holes = spark.createDataFrame([(None, "psm"), ("<P><S><M>a", None)], "output string, form string")
    assert [r.restored for r in fill_middle.restore(holes).collect()] == [None, None]


def test_fim_of_a_very_long_text_is_linear(docs):
    text = "\n".join(prose(i, 12, 50) for i in range(300_000))  # about 20 MB
    out = fill_middle.restore(fill_middle.fill_in_middle(docs([text, "a\nb"])))
    got = out.where("doc_id = 0").select("n", F.sha2("restored", 256).alias("h")).first()
    assert tuple(got) == (300_000, hashlib.sha256(text.encode()).hexdigest())


def test_fim_marks_that_cannot_be_told_apart_are_refused(docs):
    for marks in (("a", "a", "b"), ("", "a", "b"), ("aba", "c", "d")):
        with pytest.raises(ValueError):
            fill_middle.fill_in_middle(docs(["x"]), marks=marks)


def test_fim_slices_hold_all_rows_once():
    texts = pa.array(["x" * n for n in (0, 5, 50, 1, 1, 99, 0)] + [None])
    got = list(fill_middle.slices(texts, 20))
    assert [a for a, _ in got] == [0, 2, 3, 5, 6] and sum(n for _, n in got) == 8


# Collocations

ENDS = re.compile(r"[.,;:!?\x0A-\x0D]")
BLANK = re.compile(r"[^\x20\x09]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_phrases(rows, least=30, longest=4, top=2000, covered=80):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in ENDS.split((text or "").translate(LOWER)):
            words = BLANK.findall(piece)
            n[lang] += len(words)
            for i in range(len(words)):
                for m in range(1, min(longest, len(words) - i) + 1):
                    f[lang][tuple(words[i : i + m])] += 1
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        best = []
        for p, a in found.items():
            inside = any(
                len(q) > len(p) and 100 * b >= covered * a
                and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
                for q, b in found.items()
            )
            if inside:
                continue
            cuts = [(2000000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            best.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out, key=str)


def mixed(seed, many, vocabulary=12):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)] + ["É", "Straße", "漢字", "A", "a"]
    marks = [" ", "  ", "\t", ". ", ", ", "\n", "; ", " ", " ", " ", "\xa0"]
    return ["".join(rng.choice(words) + rng.choice(marks) for _ in range(rng.randrange(40))) for _ in range(many)]


@pytest.mark.parametrize("more", [{}, {"least": 3, "top": 7}, {"least": 2, "longest": 3, "covered": 50}, {"least": 5, "longest": 2}])
def test_collocations_match_brute_force(spark, more):
    texts = mixed(1, 150)
    rows = [((None, "en", "und", "", "de x")[i % 5], t) for i, t in enumerate(texts)] + [("en", None), ("en", "")]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    want = brute_phrases(rows, **more)
    assert rows_of(collocations.collocations(df, **more)) == want
    assert want or not more


def test_collocations_do_not_depend_on_shards_and_ranges(spark, monkeypatch):
    texts = mixed(2, 60) + ["x y z " * 400]
    rows = [("en" if i % 3 else "de", t) for i, t in enumerate(texts)]
    want = brute_phrases(rows, least=3)
    # Shards end in the midst of texts, and their last words wait for the next.
    sent = collocations._Shard.full
    monkeypatch.setattr(collocations._Shard, "full", lambda self: self.size >= 37)
    shard, parts = collocations._Shard(4), []
    for lang, text in rows:
        for block in collocations._blocks(text.encode().translate(collocations._PLAIN)):
            shard.add(lang.encode(), block)
            if shard.full():
                parts.append(shard.close(whole=False))
        shard.add(lang.encode(), b".")
    parts.append(shard.close(whole=True))
    whole = count_transducer.union([p for p in parts if p])
    monkeypatch.setattr(collocations._Shard, "full", sent)
    counted = collocations.phrase_counts(spark.createDataFrame(rows, "lang string, text string"), least=3)
    got = {(r.lang, r.phrase): r.f for r in counted.where("words > 0").collect()}
    mine = {}
    for depth, columns, weight in count_transducer.phrases(whole, 3):
        for row, w in zip(zip(*(c.to_pylist() for c in columns)), weight.tolist()):
            if depth:
                mine[(row[0][1:].decode(), b" ".join(row[1:]).decode())] = w
    assert got == mine
    monkeypatch.setattr(collocations, "RANGE_BYTES", 500)
    monkeypatch.setattr(collocations, "REQUESTS", 20)
    monkeypatch.setattr(collocations, "MERGE_STATES", 10)
    assert rows_of(collocations.collocations(spark.createDataFrame(rows, "lang string, text string"), least=3)) == want


def test_blocks_cut_between_words(monkeypatch):
    monkeypatch.setattr(collocations, "BLOCK_BYTES", 7)
    for text in (b"", b"a", b"a" * 50, b"ab cd.ef  gh " * 9, b" " * 30, b"." * 9, b"aaaaaaaaaaaa bbbbbbbbbbbbbbbb"):
        assert [w for b in collocations._blocks(text) for w in b.replace(b".", b" . ").split()] == text.replace(b".", b" . ").split()


def test_scores_are_exact_beyond_64_bits():
    big = 3 * 10**18
    t, _ = count_transducer.from_phrases([[b" en", b"a"], [b" en", b"a", b"b"]], [big, big - 1])
    back = count_transducer.decode(count_transducer.encode(t))
    assert count_transducer.union([back, back]).levels[2].weight.tolist() == [2 * (big - 1)]


def test_scores_use_wide_products(spark, monkeypatch):
    a, left, right = 9 * 10**17, 9 * 10**17 + 1, 10**18 + 7
    rows = [("en", "x", 1, left), ("en", "y", 1, right), ("en", "x y", 2, a), ("en", None, 0, left + right)]
    counted = spark.createDataFrame(rows, "lang string, phrase string, words int, f bigint")
    monkeypatch.setattr(collocations, "phrase_counts", lambda *args: counted)
    got = collocations.collocations(counted.withColumn("text", F.lit("")))
    assert rows_of(got) == [("en", 1, "x y", a, left, right, left + right, 2000000 * a // (left + right))]


def test_union_split_and_follow():
    rng = np.random.default_rng(5)
    seen = Counter()
    parts = []
    for _ in range(5):
        own = Counter(tuple(b"w%d" % i for i in rng.integers(0, 6, rng.integers(1, 5))) for _ in range(60))
        seen += own
        parts.append(count_transducer.from_phrases(list(own), list(own.values()))[0])
    whole = count_transducer.union(parts)
    got = Counter()
    homes = [rng.integers(0, 4, len(level.label)) for level in whole.levels]
    homes[0] = np.zeros_like(homes[0])
    for _, part in count_transducer.split(whole, homes):
        part = count_transducer.decode(count_transducer.encode(part))
        for _, columns, weight in count_transducer.phrases(part):
            for row, w in zip(zip(*(c.to_pylist() for c in columns)), weight.tolist()):
                got[row] += w if len(row) > 1 else 0
    # The first level is the root label and carries no count of its own.
    assert +got == {p: n for p, n in seen.items() if len(p) > 1}
    asked = list(seen) + [(b"w9",), (b"w1", b"nope"), (b"w0",) * 6]
    want, ends = count_transducer.from_phrases(asked, [1] * len(asked))
    weight = count_transducer.follow(whole, want)
    assert [int(weight[d][s]) for d, s in ends] == [seen.get(p, 0) for p in asked]


def test_collocations_handle_awkward_rows(awkward):
    df, rows = awkward
    want = brute_phrases([(r[2], r[1]) for r in rows], least=12)
    assert rows_of(collocations.collocations(df, least=12)) == want


def test_collocations_of_nothing(nothing):
    assert collocations.collocations(nothing).count() == 0


# Relative parsing


def brute_removed(rows, least):
    first = {}
    for key, text in rows:
        words = (text or "").split() if text is None or text.isascii() else re.findall(r"[^\x20\x09-\x0D]+", text)
        for p in range(len(words) - least + 1 if key is not None else 0):
            name = tuple(words[p : p + least])
            first[name] = min(first.get(name, key), key)
    out = []
    for key, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = set()
        for p in range(len(words) - least + 1 if key is not None else 0):
            if first[tuple(words[p : p + least])] < key:
                gone.update(range(p, p + least))
        out.append((key, len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return sorted(out, key=str)


def parsed(df, **more):
    return relative_parse.substring_dedup(df, **more)


@pytest.mark.parametrize("least,k,vocabulary", [(6, 2, 3), (6, 3, 5), (10, 4, 40), (50, 16, 2)])
def test_parse_matches_brute_force(spark, least, k, vocabulary):
    rng = random.Random(least * vocabulary)
    base = [[f"w{rng.randrange(vocabulary)}" for _ in range(4 * least)] for _ in range(4)]
    rows = []
    for i in range(80):
        words = [f"u{rng.randrange(999)}" for _ in range(rng.randrange(least))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(3 * least)
            words += rng.choice(base)[at : at + rng.randrange(2 * least)] + [f"v{rng.randrange(vocabulary)}"]
        rows.append((rng.choice([i, i, i, i % 9, None]), rng.choice([" ", "\n", " \t"]).join(words)))
    rows += [rows[5], rows[6], (3, None), (4, "")]
    got = parsed(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), least=least, k=k)
    want = brute_removed(rows, least)
    assert rows_of(got.drop("factors")) == want
    assert sum(r[2] for r in want) > 0


def test_factors_say_where_the_words_first_stand(docs):
    passage = prose(1, 120).split()
    texts = [" ".join(passage), prose(2, 30) + " " + " ".join(passage[20:110]) + " " + prose(3, 30), prose(4, 200)]
    out = {r.doc_id: r for r in parsed(docs(texts)).collect()}
    assert [tuple(f) for f in out[1].factors] == [(30, 90, 0, 20)]
    assert out[1].kept_text == " ".join(texts[1].split()[:30] + texts[1].split()[120:])
    assert out[0].n_removed == out[2].n_removed == 0 and not out[2].factors


def test_a_passage_many_texts_share_goes_from_all_but_the_first(docs):
    passage = prose(9, 70)
    texts = [f"{prose(100 + i, 12)} {passage} {prose(500 + i, 9)}" for i in range(300)] + [passage] * 50
    out = rows_of(parsed(docs(texts).repartition(6)).drop("factors"))
    assert out == brute_removed(list(enumerate(texts)), 50)


def test_parse_handles_awkward_rows(awkward):
    df, rows = awkward
    assert rows_of(parsed(df).drop("factors")) == brute_removed([(r[0], r[1]) for r in rows], 50)


def test_parse_of_nothing(nothing):
    assert parsed(nothing).count() == 0


def test_equal_seeds_of_other_words_decide_nothing(docs, monkeypatch):
    texts = [prose(i, 80) for i in range(6)] + [prose(2, 80)]
    real = relative_parse._phrases_of
    monkeypatch.setattr(relative_parse, "_phrases_of", lambda *a: (lambda s, f: (np.zeros_like(s), f))(*real(*a)))
    out = {r.doc_id: r.n_removed for r in parsed(docs(texts)).collect()}
    assert out == {**{i: 0 for i in range(6)}, 6: 80}


def test_string_keys_compare_as_strings(spark):
    text = prose(1, 60)
    df = spark.createDataFrame([("b", text), ("a", text), ("c", prose(2, 60))], "name string, body string")
    out = parsed(df, key="name", text="body")
    assert {r.doc_id: r.n_removed for r in out.collect()} == {"a": 0, "b": 60, "c": 0}
