"""Classifier, BPE, token files, secrets, near duplicates and passages against brute force."""

import base64
import bz2
import gzip
import hashlib
import lzma
import random
import re
import urllib.parse
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from estate.llm import bpe, near_dup, quality_classifier, queries, secrets, suffix_dedup, token_files, wordhash

from .conftest import prose

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PATTERN = public_tokenizers.PATTERN
END = 50256


# Classifier


def test_classifier_learns_and_scores_whole_texts(spark, docs):
    rng = random.Random(5)
    texts, labels = [], []
    for i in range(200):
        good = i % 3 > 0
        text = prose(i, rng.randrange(20, 80))
        texts.append(text if good else " ".join(w + "!!" for w in text.upper().split()))
        labels.append((i, int(good)))
    df = docs(texts)
    known = spark.createDataFrame(labels, "doc_id bigint, quality int")
    model = quality_classifier.fit(df, known.where(~quality_classifier.held_out()))
    got = quality_classifier.score(df, model).join(known, "doc_id").where(quality_classifier.held_out()).collect()
    assert len(got) > 20
    assert sum((r.score >= 0.5) == (r.quality == 1) for r in got) >= 0.95 * len(got)
    # A tail that is far behind the start counts as well.
    far = docs([prose(1, 3000), prose(1, 3000) + " " + " ".join(["SHOUT!!"] * 3000)])
    first, second = (r.score for r in quality_classifier.score(far, model).orderBy("doc_id").collect())
    assert second < first


def brute_features(text):
    """The same features one at a time, as strings."""
    space = set(b" \t\n\r\x0b\x0c")
    data = bytes(32 if b in space else b for b in text.encode() + b" ")
    out = []
    for n in quality_classifier.SIZES:
        for i in range(len(data) - n + 1):
            run = data[i : i + n]
            if b" " not in run[1:-1] and not (run[:1] == b" " and run[-1:] == b" "):
                out.append((n, run))
    words = data.split()
    out += [(0, w) for w in words]
    out += [(1, "same" if a == b else (a, b)) for a, b in zip(words, words[1:])]
    return out


def test_features_match_brute_force():
    texts = ["", "a", "aa bb bb  cc", "one two\ttwo", " \n", "é漢 x x x"]
    joined = b"".join(t.encode() + b" " for t in texts)
    starts = np.concatenate(([0], np.cumsum([len(t.encode()) + 1 for t in texts])[:-1]))
    bucket, place = quality_classifier._features(np.frombuffer(joined, np.uint8), starts)
    row = np.searchsorted(starts, place, "right") - 1
    name = {}
    for i, text in enumerate(texts):
        alone, _ = quality_classifier._features(np.frombuffer(text.encode() + b" ", np.uint8), np.zeros(1, int))
        inside = Counter(bucket[row == i].tolist())
        want = brute_features(text)
        if i:  # a run over the seam of two texts begins in the first of them
            assert not Counter(alone.tolist()) - inside
        assert sorted(Counter(alone.tolist()).values()) == sorted(Counter(want).values())
    del name


def test_classifier_handles_awkward_rows(spark, awkward, nothing):
    df, rows = awkward
    labels = spark.createDataFrame([(1, 1), (1, 0), (5, 0), (None, 1), (7, None)], "doc_id bigint, quality int")
    model = quality_classifier.fit(df, labels)
    got = quality_classifier.score(df, model).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    assert all(0 <= r.score <= 1 for r in got)
    blank = quality_classifier.fit(nothing, labels)
    assert {r.score for r in quality_classifier.score(df, blank).collect()} == {0.5}
    assert quality_classifier.score(nothing, model).count() == 0


# BPE


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def awkward_texts():
    rng = random.Random(3)
    letters = [chr(c) for c in range(0x500)] + ["漢", "字", "\U0001f600", " ", "　", "\x85", "﻿", "'s", "<|endoftext|>"]
    texts = ["", " ", "a", "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "don't we'LL", "  two  spaces \n\n end ", "1234567 8"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(300)]
    return texts + ["".join(rng.choice("abeinorst '") for _ in range(400)) for _ in range(60)] + ["ab" * 3000, "\n" * 500]


@pytest.mark.parametrize("nodes", [50, 10**6])
def test_bpe_matches_the_library(library, nodes):
    texts = awkward_texts()
    own = bpe.Bpe(VOCABULARY, PATTERN, max_nodes=nodes)
    for at in range(0, len(texts), 40):
        part = texts[at : at + 40]
        got = own.encode(part)
        want = [e.ids for e in library.encode_batch(part, add_special_tokens=False)]
        assert got == want
        assert [own.decode(ids) for ids in got] == library.decode_batch(want, skip_special_tokens=False)


def test_bpe_digests_in_pieces_of_a_batch(docs, spark):
    import inspect

    texts = ["one two three", "", None, "a \U0001f600 é", "<|endoftext|>, x"] * 3
    coded = bpe.encode(docs(texts).coalesce(1), VOCABULARY, PATTERN).orderBy("doc_id")
    broken = coded.withColumn("ids", F.expr("if(doc_id = 0, array(0, 255, 200, 7), ids)"))
    own, sha = bpe.Bpe(VOCABULARY, PATTERN), lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(r.doc_id, len(r.ids), sha(",".join(map(str, r.ids))), sha(own.decode(r.ids))) for r in broken.collect()]
    assert sorted(map(tuple, bpe.digests(broken, VOCABULARY, PATTERN).collect())) == want
    # Ids are not turned into Python numbers one by one.
    assert "to_pylist" not in inspect.getsource(bpe.digests)
    table = pa.array([b"%d," % i for i in range(5)], pa.large_binary())
    runs = bpe._joined(table, pa.array([1, 2, 4, 0], pa.int32()).slice(1), np.array([0, 0, 2, 3]))
    assert [bytes(r) for r in runs] == [b"", b"2,4,", b"0,"]


def test_bpe_digests(docs, library, awkward, nothing):
    texts = awkward_texts()[:60] + [None]
    got = bpe.digests(bpe.encode(docs(texts), VOCABULARY, PATTERN), VOCABULARY, PATTERN).orderBy("doc_id").collect()
    for row, text in zip(got, texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        plain = library.decode(ids, skip_special_tokens=False)
        assert row.decoded_sha256 == hashlib.sha256(plain.encode()).hexdigest()
    df, rows = awkward
    n = Counter((r.doc_id, len(r.ids)) for r in bpe.encode(df, VOCABULARY, PATTERN).collect())
    assert n == Counter((r[0], len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)
    assert bpe.digests(bpe.encode(nothing, VOCABULARY, PATTERN), VOCABULARY, PATTERN).count() == 0


# Token files


@pytest.mark.parametrize("block", [1, 2, 7, 1 << 20])
def test_scan_stitches_blocks(spark, tmp_path, block):
    rng = random.Random(block)
    want = []
    for n in range(5):
        lengths = [rng.randrange(0, 30) for _ in range(40)] if n else []
        tail = [0, 0, 3, 50, 0][n]
        data = [t for size in lengths for t in [*range(1, size + 1), 9999]] + [5] * tail
        path = str(tmp_path / f"{n}.bin")
        np.array(data, "<u2").tofile(path)
        at = 0
        for d, size in enumerate([*lengths, *([tail] if tail else [])]):
            want.append((path, d, at, size, d < len(lengths)))
            at += size + 1
    paths = spark.createDataFrame([(p, 1) for p in {w[0] for w in want}] * 2 + [(str(tmp_path / "0.bin"), 1), (None, 1)], "path string, row int")
    got = token_files.scan_token_files(paths, 9999, block_tokens=block)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_a_torn_file_is_refused(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"123")
    paths = spark.createDataFrame([(str(tmp_path / "x.bin"),)], "path string")
    with pytest.raises(Exception, match="inside a token"):
        token_files.scan_token_files(paths, 1).collect()


def test_written_documents_are_counted(spark, awkward, nothing, library):
    df, rows = awkward
    index = token_files.write_token_files(bpe.encode(df.repartition(3), VOCABULARY, PATTERN), END)
    got = Counter(tuple(r) for r in token_files.token_counts(index, END, block_tokens=11).collect())
    assert got == Counter((r[0], len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)
    index = token_files.write_token_files(bpe.encode(nothing, VOCABULARY, PATTERN), END)
    assert token_files.token_counts(index, END).count() == 0


def test_a_spelt_out_separator_ends_no_document(spark, docs, library, tmp_path):
    texts = ["one two", "before <|endoftext|> after it", "three four five", "<|endoftext|>", "six"]
    docs(texts).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op6_token_counts(spark, str(tmp_path))
    want = [(i, len(library.encode(t, add_special_tokens=False).ids)) for i, t in enumerate(texts)]
    assert sorted(map(tuple, got.collect())) == want
    assert queries.END_OF_DOCUMENT not in bpe.Bpe(VOCABULARY, PATTERN).token
    with pytest.raises(Exception, match="stands inside a row"):
        token_files.write_token_files(bpe.encode(docs(texts), VOCABULARY, PATTERN), END)


def test_packing_counts_tokens(spark, docs, library, tmp_path):
    texts = ["one two three", "https://example.org/" + "a1b2" * 2000, "", None, "漢字" * 50]
    docs(texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter()
    for r in queries.op2_packing(spark, str(tmp_path)).collect():
        assert r.n_tokens <= 2048
        got[r.doc_id] += r.n_tokens
    want = {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    assert want[1] > 2048 and got == Counter({i: n for i, n in want.items() if n})


# Secrets

KEY = "AKIA" + "B7" * 9


def brute_base(text):
    kinds = [
        ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         lambda m: len(m[2]) >= 12),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18), ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 16),
    ]
    found = [(m.start(), k, m.end()) for k, (_, p, ok) in enumerate(kinds) for m in re.finditer(p, text) if ok(m)]
    return ",".join(f"{kinds[k][0]}:{a}:{b}" for a, k, b in sorted(found))


def test_base_finds_match_brute_force():
    rng = random.Random(1)
    pieces = ["token", "PassWord", "api_key", "apikey", " ", "=", ":", '"', "'", "abcdefabcdef", "AKIA", "ABCDEF0123456789", "0123456789abcdef", "é", "\n", "ſecret", "secret", "toKen"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(14)))
        base, every = secrets.find_all(text)
        assert secrets.told(base) == brute_base(text), text
        assert set(base) <= set(every)


def wrapped(plain, rng):
    """The text in a few layers, inside which nothing else is to be found."""
    for _ in range(rng.randrange(1, 5)):
        kind = rng.randrange(5)
        if kind == 0:
            plain = "".join(f"%{b:02X}" for b in plain.encode())
        elif kind == 1:
            plain = "".join(f"\\u{ord(c):04x}" for c in plain)
        elif kind == 2:
            plain = base64.b64encode(plain.encode()).decode()
        elif kind == 3:
            plain = base64.b64encode(zlib.compress(plain.encode())).decode()
        else:
            plain = base64.urlsafe_b64encode(gzip.compress(plain.encode())).decode()
    return plain


@pytest.mark.parametrize("seed", range(60))
def test_nested_layers_are_unwrapped(seed):
    rng = random.Random(seed)
    secret = rng.choice([KEY, "password = 'hunter2hunter2'", "api_key:abcdefghijkl.mn", "00112233445566778899"])
    run = wrapped(f"see {secret} here", rng)
    text = f"héad {run} tail"
    base, found = secrets.find_all(text)
    kind = 1 if secret == KEY else 2 if secret[0] == "0" else 0
    inside = [s for s in found if s[0] == kind and 5 <= s[1] < s[2] <= 5 + len(run)]
    assert inside, text
    assert not secrets.redacted(text, found).count(secret)


def test_escapes_map_to_their_characters():
    text = "a p%61ssword%3D" + urllib.parse.quote("é") + "x token%3Dabcdefghijklmn."
    found = secrets.find_all(text)[1]
    assert [text[a:b] for _, a, b in found] == ["token%3Dabcdefghijklmn."]
    text = "&#116;oken=\\x61bcdefghijklmn;"
    assert [text[a:b] for _, a, b in secrets.find_all(text)[1]] == [text[:-1]]


def test_what_decodes_to_itself_ends(monkeypatch):
    monkeypatch.setattr(secrets, "_unpacked", lambda run, room: run)
    assert secrets.find_all("A" * 40) == ([], [])
    monkeypatch.setattr(secrets, "_unpacked", lambda run, room: run.swapcase())
    assert secrets.find_all("Ab" * 40) == ([], [])


def test_a_bomb_is_told(monkeypatch):
    monkeypatch.setattr(secrets, "MAX_DECODED", 10_000)
    run = base64.b64encode(zlib.compress(b"0" * 100_000)).decode()
    assert secrets.find_all(run)[1][-1] == (3, 0, len(run))


def test_the_guard_covers_one_run_alone(monkeypatch):
    # Escapes in a long text, by several paths, cost no room; a run beside a bomb is scanned.
    monkeypatch.setattr(secrets, "MAX_DECODED", 10_000)
    bomb = base64.b64encode(zlib.compress(b"0" * 100_000)).decode()
    run = base64.b64encode(b"see token=abcdefghijklmn here").decode()
    plain = "clean words, " * 5_000
    text = f"{plain}%41 \\u0041, {bomb}, {plain}{run}"
    found = secrets.find_all(text)[1]
    at, last = text.index(bomb), text.index(run)
    assert found == [(3, at, at + len(bomb)), (0, last, last + len(run))]
    assert secrets.redacted(text, found).count(plain) == 2


def test_a_layer_is_scanned_once_at_its_place(monkeypatch):
    seen, scan = [], secrets.scan
    monkeypatch.setattr(secrets, "scan", lambda text: seen.append(text) or scan(text))
    secrets.find_all("a%41\\u0042z")
    assert sorted(seen) == sorted({"a%41\\u0042z", "aA\\u0042z", "a%41Bz", "aABz"})


def _lines(run, width, end="\n"):
    return end.join(run[i : i + width] for i in range(0, len(run), width))


@pytest.mark.parametrize("pack", [gzip.compress, bz2.compress, lzma.compress, zlib.compress])
def test_every_compressed_member_is_scanned(pack):
    filler = " ".join(str(n * 7919) for n in range(60)).encode()
    run = base64.b64encode(pack(filler) + pack(b"see " + KEY.encode() + b" here")).decode()
    assert (1, 0, len(run)) in secrets.find_all(run)[1]
    for width, end in ((64, "\n"), (76, "\r\n")):
        text = f"Content:\n{_lines(run, width, end)}\n--end of it"
        found = [s for s in secrets.find_all(text)[1] if s[0] == 1]
        assert found and text[found[0][1] : found[0][2]] == _lines(run, width, end)
    glued = f"see /files/a_b/{run}"
    assert any(k == 1 for k, _, _ in secrets.find_all(glued)[1])


def test_wrapped_glued_and_unclean_runs_are_scanned():
    plain = b"x" * 40 + KEY.encode() + b"y " * 30
    wrapped = _lines(base64.b64encode(plain).decode(), 64)
    assert any(k == 1 and b - a == len(wrapped) for k, a, b in secrets.find_all(wrapped)[1])
    run = base64.b64encode(b"see " + KEY.encode() + b" here").decode()
    for glue in ("", "a", "ab", "abc", "/path/", "a-b_"):
        assert any(k == 1 for k, _, _ in secrets.find_all(glue + run)[1]), glue
    for flaw in (b"\x00\x01", b"\xff\xfe"):
        run = base64.b64encode(flaw + b" see " + KEY.encode() + b" here" + flaw).decode()
        assert any(k == 1 for k, _, _ in secrets.find_all(run)[1])


def test_secrets_handle_awkward_rows(awkward, nothing):
    df, rows = awkward
    got = secrets.secret_scan(df)
    assert Counter(r.base_sha256 for r in got.collect()) == Counter(
        hashlib.sha256(brute_base(r[1] or "").encode()).hexdigest() for r in rows
    )
    masked = secrets.mask_secrets(df)
    assert masked.schema == df.schema
    assert Counter(r.text for r in masked.collect()) == Counter(r[1] for r in rows)
    assert secrets.secret_scan(nothing).count() == 0 and secrets.mask_secrets(nothing).count() == 0


def test_masking_takes_overlaps_as_one():
    text = f"token={KEY.lower()}0123456789abcdef0 end {KEY}"
    assert secrets.redacted(text, secrets.find_all(text)[1]) == "[assign] end [access]"


# Near duplicates


def brute_sets(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def brute_components(rows, size, percent):
    sets = [brute_sets(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    keys = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            keys[find(i)] = min(keys.get(find(i), key), key)
    out = []
    for i, (key, _) in enumerate(rows):
        least = keys.get(find(i))
        out.append((key, len(sets[i]), least, key == least))
    return sorted(out, key=str)


def changed(text, share, rng):
    return " ".join(f"z{rng.randrange(10**6)}" if rng.random() < share else w for w in text.split())


def near_texts(seed):
    rng = random.Random(seed)
    texts = []
    for g in range(12):
        base = prose(seed * 100 + g, rng.randrange(3, 120), 300)
        texts.append(base)
        for _ in range(rng.randrange(0, 9)):
            # Around the threshold, and in chains away from it.
            base = changed(base, rng.choice([0, 0.01, 0.04, 0.06, 0.1]), rng) if rng.random() < 0.5 else base
            texts.append(changed(texts[-1] if rng.random() < 0.4 else base, rng.choice([0, 0.02, 0.05, 0.08]), rng))
    texts += ["one", "ONE", "one two", "One  two", "", None, " \n", "two one"]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("size", [2, 5])
@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_match_brute_force(docs, seed, size):
    texts = near_texts(seed)
    got = near_dup.near_duplicates(docs(texts), words=size)
    assert sorted(map(tuple, got.collect()), key=str) == brute_components(list(enumerate(texts)), size, 80)


def test_a_large_group_of_near_copies(docs):
    rng = random.Random(9)
    base = prose(77, 60)
    texts = [changed(base, 0.03, rng) for _ in range(150)] + [base] * 60 + [prose(i, 50) for i in range(30)]
    got = near_dup.near_duplicates(docs(texts), words=2)
    assert sorted(map(tuple, got.collect()), key=str) == brute_components(list(enumerate(texts)), 2, 80)


@pytest.mark.parametrize("words, share", [(2, 0.09), (5, 0.05)])
def test_pairs_of_a_large_group_grow_with_its_members(docs, monkeypatch, words, share):
    """Copies changed in places of their own, most of them too far from every other."""
    rng = random.Random(5)
    base = prose(78, 100)
    texts = [base] + [changed(base, share, rng) for _ in range(300)]
    texts += [changed(texts[n], 0.01, rng) for n in range(1, 100)]  # and some that link to these alone
    made = {}

    def counted(df, label, write=near_dup.materialize):
        out = write(df, label)
        made[label] = out.count()
        return out

    monkeypatch.setattr(near_dup, "materialize", counted)
    got = near_dup.near_duplicates(docs(texts), words=words)
    assert sorted(map(tuple, got.collect()), key=str) == brute_components(list(enumerate(texts)), words, 80)
    assert made["third-pairs"] < len(texts)


def test_near_duplicates_handle_awkward_rows(awkward, nothing):
    df, rows = awkward
    got = near_dup.near_duplicates(df, words=2)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        [(k, n, c if k is not None or n else k, k == (c if k is not None or n else k)) for k, n, c, _ in brute_components([(r[0], r[1]) for r in rows], 2, 80)],
        key=str,
    )
    assert near_dup.near_duplicates(nothing).count() == 0


def test_batches_keep_similar_pairs():
    needed = near_dup.least_matches(0.8, 1e-6)
    assert [n for n, _ in needed] == [32, 64, 96, 128, 160]
    rng = np.random.default_rng(1)
    hits = rng.random((20_000, 160)) < 0.8
    assert all((hits[:, :n].sum(axis=1) >= m).mean() > 0.9999 for n, m in needed)
    miss = rng.random((20_000, 160)) < 0.3
    assert (miss[:, :64].sum(axis=1) >= needed[1][1]).mean() < 0.01


def test_components_of_chains_and_stars(spark):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 200), (202, 202)]
    rng.shuffle(pairs)
    name = lambda n: n.to_bytes(2, "big")
    links = spark.createDataFrame([(name(a), name(b)) for a, b in pairs], "a binary, b binary")
    got = {int.from_bytes(r.set_id, "big"): int.from_bytes(r.label, "big") for r in near_dup.components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {200: 200, 201: 200}


# Passages


def brute_passages(rows, least):
    windows = Counter()
    split = [(k, (t or "").split()) for k, t in rows]
    for _, words in split:
        windows.update(tuple(words[i : i + least]) for i in range(len(words) - least + 1))
    out = []
    for key, words in split:
        inside = [i for i in range(len(words) - least + 1) if windows[tuple(words[i : i + least])] > 1]
        start = None
        for i in inside:
            if start is not None and i <= last + least:
                last = i
                continue
            if start is not None:
                out.append((key, start, last + least))
            start = last = i
        if start is not None:
            out.append((key, start, last + least))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(4))
def test_passages_match_brute_force(docs, seed):
    rng = random.Random(seed)
    shared = [prose(1000 + seed * 10 + i, rng.randrange(12, 60), 50 if i % 2 else 5000) for i in range(6)]
    texts = []
    for i in range(60):
        parts = [prose(seed * 1000 + i, rng.randrange(0, 60))]
        for _ in range(rng.randrange(0, 4)):
            words = rng.choice(shared).split()
            a, b = sorted(rng.sample(range(len(words) + 1), 2))
            parts += [" ".join(words[a:b] if rng.random() < 0.7 else words), prose(i + 500, rng.randrange(0, 9), 5)]
        texts.append(rng.choice([" ", "\n", "\t "]).join(parts))
    texts += ["a " * 70, "a b " * 40, texts[0], None, "", "x"]
    got = suffix_dedup.repeated_passages(docs(texts), least=20, k=6)
    assert sorted(((r.doc_id, r.start_word, r.end_word) for r in got.collect()), key=str) == brute_passages(
        [(i, t) for i, t in enumerate(texts)], 20
    )


def test_passages_leave_one_copy(docs):
    passage = prose(5, 80)
    texts = [prose(i, 30) + " " + passage + " " + prose(i + 50, 30) for i in range(4)]
    got = {r.doc_id: r for r in suffix_dedup.repeated_passages(docs(texts)).collect()}
    assert set(got) == {0, 1, 2, 3}
    assert all((r.start_word, r.end_word) == (30, 110) for r in got.values())
    assert got[0].n_spare == 0


def test_passages_handle_awkward_rows(awkward, nothing):
    df, rows = awkward
    got = suffix_dedup.repeated_passages(df)
    assert sorted(((r.doc_id, r.start_word, r.end_word) for r in got.collect()), key=str) == brute_passages(
        [(r[0], r[1]) for r in rows], 50
    )
    assert suffix_dedup.repeated_passages(nothing).count() == 0


def test_windows_that_agree_in_half_a_name_are_no_match(docs):
    # One seed in many contexts, of which two have windows with the same 32 upper bits.
    vocabulary = [f"w{n}" for n in range(4000)]
    hashes = wordhash._words([" ".join(vocabulary).encode()])[0]
    rng = np.random.default_rng(5)
    runs = rng.integers(0, len(vocabulary), 16 * 100_000)
    at = int(np.argmin(suffix_dedup._named(hashes[runs], 16)))  # the seed nearly every window has
    texts = rng.integers(0, len(vocabulary), (300_000, 50))
    texts[:, 17:33] = runs[at : at + 16]
    names = suffix_dedup._named(hashes[texts.reshape(-1)], 50)[::50]
    order = np.argsort(names)
    near = np.flatnonzero(np.diff(names[order] >> np.uint64(32)) == 0)
    assert len(near)
    for i in near:
        pair = [" ".join(vocabulary[w] for w in texts[order[j]]) for j in (i, i + 1)]
        seeds = {int(s[0]) for p in pair for _, s, _, _ in suffix_dedup._suffixes(*wordhash._words([p.encode()]), 50, 16)}
        if len(seeds) == 1:
            break
    else:
        raise AssertionError("no pair with one seed")
    assert suffix_dedup.repeated_passages(docs(pair)).count() == 0
    assert suffix_dedup.repeated_passages(docs([pair[0]] * 2)).count() == 2


# Secrets in large runs


def test_large_runs_of_random_bytes_are_looked_through_and_told_as_nothing():
    import time

    rng = random.Random(6)

    def seconds(megabytes, inside=b""):
        raw = rng.randbytes(megabytes * 500_000) + inside + rng.randbytes(megabytes * 250_000)
        text = "data: " + base64.b64encode(raw).decode()
        began = time.monotonic()
        found = secrets.find_all(text)[1]
        assert all(kind < len(secrets.KINDS) for kind, _, _ in found)  # nothing opaque
        return time.monotonic() - began, len(text), found

    small, *_ = seconds(1)
    large, length, found = seconds(8)
    assert large < 20 * small + 2
    # A find inside, plain or compressed in the midst of it, is still seen.
    for inside in (b" password = abcdefgh12345678 ", gzip.compress(b" password = abcdefgh12345678 " * 3)):
        took, length, found = seconds(4, inside)
        assert (0, 6, length) in found
        assert took < 10 * small + 2


# Token counts without tokens


def test_new_words_are_counted_without_a_trie():
    mine, other = bpe.Bpe(VOCABULARY, PATTERN), bpe.Bpe(VOCABULARY, PATTERN)
    rng = random.Random(13)
    letters = "eeeettaaooiinnsshhrrdlcumwfgypbvkjxqzé漢0'.-"
    texts = [" ".join("".join(rng.choices(letters, k=rng.randrange(1, 30))) for _ in range(200)) for _ in range(20)]
    assert mine.count(texts) == [len(ids) for ids in other.encode(texts)]
    assert len(mine.last) == 1
    # Long ones still go through it.
    texts = ["".join(rng.choices("abcdefgh", k=n)) for n in (63, 64, 65, 66, 500)] + ["a" * 63, "a" * 64, "ab" * 40]
    assert mine.count(texts) == [len(ids) for ids in other.encode(texts)]


def test_counts_are_those_of_the_library():
    library = Tokenizer.from_file(VOCABULARY)
    mine = bpe.Bpe(VOCABULARY, PATTERN)
    rng = random.Random(12)
    parts = [" ", "  ", "\t", "\n", " \n", "\n ", "\xa0", "\u3000", "\x1c", "\x85", "a", "I'll", "don't", "'s", "'", "x1y2", "123",
             "é", "漢字", "\U0001f600", "...", "<|endoftext|>", "Hello", "\r\n", "\u200b", "ſ", "\u2028"]
    texts = ["", " ", "a", " a", "a ", "a  b", "it's  'll", "<|endoftext|>", "a <|endoftext|> b"]
    texts += ["".join(rng.choices(parts, k=rng.randrange(40))) for _ in range(4000)]
    texts += [" ".join(rng.choices(parts, k=rng.randrange(40))) for _ in range(2000)]
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert mine.count(texts) == want
    assert mine.count(texts) == want  # from what is known now
    mine.max_nodes = 50
    assert [n for i in range(0, len(texts), 97) for n in mine.count(texts[i : i + 97])] == want


def test_lengths_of_awkward_rows(awkward, nothing):
    df, rows = awkward
    library = Tokenizer.from_file(VOCABULARY)
    got = sorted(((r.doc_id, r.n_tokens) for r in bpe.lengths(df, VOCABULARY, PATTERN).collect()), key=str)
    want = [(r[0], len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows]
    assert got == sorted(want, key=str)
    assert bpe.lengths(nothing, VOCABULARY, PATTERN).count() == 0
