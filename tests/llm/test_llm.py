"""Each operator on odd rows (nulls, empty and long texts, ties, repeats, clashing columns, empty tables), against
brute force, exact round trips or held-out accuracy."""

import functools
import hashlib
import os
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from rootweave.llm import chat, decontam, fingerprints, language, line_runs, near_dups, packing, queries, run_index, token_counts, token_files
from rootweave.llm.components import components
from rootweave.llm.vocab import PieceEncoder, default_vocabulary

tokenizers = pytest.importorskip("tokenizers")
SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, lost string, head string, root long, bin int"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def _text(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ".", ",", "\n"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = [_text(rng, rng.randrange(20, 90)) for _ in range(16)]
    long = _text(rng, 6000)
    edited = base[0].split(" ")
    edited[3] = "other"
    texts = [*base, base[0], base[0], " ".join(edited), base[1] + " tail", long, long[: len(long) // 2], None, "", "   \n\t", "x", "Ünïcode ß É 日本語", "same line of twenty chars\n" + base[2], "  SAME line of twenty chars\t\n" + base[3], "same line of twenty chars", "double  blank  text <|endoftext|> it's", "a" * 1000]
    made = [(i, t, rng.choice(["en", "de", None]), "hot" if i % 3 else None, None, "k", "l", "h", 7, 1) for i, t in enumerate(texts)]
    return [*made, made[4], (None, "lone text without an id", None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def _by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_winnowing_equals_a_plain_loop(spark, docs, rows, none):
    got = docs.select("text", fingerprints.winnow(F.col("text"), 5, 5).alias("f")).collect()
    by_text = {}
    for r in got:
        assert by_text.setdefault(r["text"], r["f"]) == r["f"]
        picked = sorted(fingerprints._TOP - (x & fingerprints._TOP) for x in r["f"])
        units = __import__("regex").findall(fingerprints.UNIT, r["text"] or "")
        windows = max(0, len(units) - 4 - 4)
        assert (not units) == (not picked)
        assert all(any(i <= p < i + 5 for p in picked) for i in range(windows))  # every window has its choice
    assert fingerprints.with_next(none).count() == 0
    one = fingerprints.with_next(docs.filter("doc_id = 3"), bits=2).first()
    assert one["text"] == one["next_text"]
    found = {r["doc_id"]: r["next_text"] for r in fingerprints.with_next(docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), bits=2).collect()}
    ids = sorted(found, reverse=True)
    texts = {r[0]: r[1] or "" for r in rows}
    assert found == {d: texts[n] for d, n in zip(ids, ids[1:] + ids[:1], strict=True)}


def _fingerprint(text, k=5, window=5):
    """(hash, position) pairs by a plain loop over units, grams and windows."""
    mixed = lambda *xs: functools.reduce(lambda seed, x: xxhash.xxh64_intdigest(struct.pack("<Q", x), seed), (x for x in xs if x is not None), 42)
    units = [xxhash.xxh64_intdigest(u.encode(), 42) for u in regex.findall(fingerprints.UNIT, text)]
    at = lambda row, i: row[i] if i < len(row) else None
    two = [mixed(units[i], at(units, i + 1)) for i in range(len(units))]
    four = [mixed(two[i], at(two, i + 2)) for i in range(len(units))]
    grams = [mixed(four[i], at(units, i + 4)) >> 32 for i in range(len(units))][: max(len(units) - k + 1, min(1, len(units)))]
    chosen = {}
    for i in range(max(len(grams) - window + 1, min(1, len(grams)))):
        part = grams[i : i + window]
        j = max(j for j, x in enumerate(part) if x == min(part))
        chosen[i + j] = part[j]
    return sorted((p, h) for p, h in chosen.items())


def test_fingerprint_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(14)
    ids = [*{rng.randrange(-(1 << 62), 1 << 62) for _ in range(30)}, *range(40)]
    rows = [(d, rng.choice([None, "", "x y", "  ", _text(rng, 3), _text(rng, rng.randrange(5, 120)), "same " * 30, "日本語 ß"])) for d in ids]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = _by_id(queries.op1_fingerprints(spark, str(tmp_path)))
    ordered = sorted(((d, t or "") for d, t in rows), reverse=True)
    alike = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    sets = lambda f: {h for _, h in f}
    for (d, text), (_, after) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        r, third = got[d], len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        own, new, later = map(_fingerprint, (text, edited, after))
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r["fingerprint"] == "".join(f"{h:08x}" for _, h in own) and r["edited_fingerprint"] == "".join(f"{h:08x}" for _, h in new)
        assert r["positions"] == ",".join(str(p) for p, _ in own)
        assert abs(r["near_edited"] - alike(sets(own), sets(new))) < 1e-12 and abs(r["near_next"] - alike(sets(own), sets(later))) < 1e-12


def test_edits_of_unspaced_text_stay_local(spark):
    rng = random.Random(3)
    rows = []
    for letters in ("abcdefghijklmnopqrstuvwxyz", "的一是不了人我在有他这中大来上国", "กขคงจฉชซญฎ", "0123456789"):
        text = "".join(rng.choice(letters) for _ in range(1200))
        rows += [(text, "x" + text), (text, text[:600] + "x" + text[600:])]
    table = spark.createDataFrame(rows, "a string, b string")
    own, new = (fingerprints.hashes(fingerprints.winnow(F.col(c))) for c in ("a", "b"))
    assert all(r["like"] > 0.9 for r in table.select(fingerprints.likeness(own, new).alias("like")).collect())


def test_documents_without_ids_have_neighbours_too(spark, rows):
    frame = spark.createDataFrame([(None if i % 3 else i, f"text {i % 7}") for i in range(60)], "doc_id long, text string").repartition(4)
    found = fingerprints.with_next(frame, bits=2).collect()
    assert len(found) == 60 and all(r["next_text"] is not None for r in found)
    assert sorted(r["next_text"] for r in found) == sorted(r["text"] for r in found)  # one cycle through all


def test_ties_take_the_rightmost(spark):
    df = spark.createDataFrame([(" ".join(["mine"] * 12),)], "text string")
    f = df.select(fingerprints.positions(fingerprints.winnow(F.col("text"), 2, 4)).alias("p")).first()["p"]
    assert f == list(range(3, 11))


def test_token_counts_equal_the_library(docs, rows, none):
    path = default_vocabulary("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    got = _by_id(token_counts.token_counts(docs, path, 50))
    for r in rows:
        text = r[1] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (got[r[0]]["n_bytes"], got[r[0]]["n_tokens"], got[r[0]]["over_limit"]) == (len(text.encode()), n, n > 50)
    assert token_counts.token_counts(none, path).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pieces_encode_as_whole_texts(name):
    rng = random.Random(2)
    alphabet = "ab '\x85​\xa0éÉ1٣ß\n̈ΣA.,日\x1c²Ⅷ"
    texts = ["".join(rng.choice(alphabet) for _ in range(40)) for _ in range(150)] + ["", " ", "  a b", "a  b ", "x <|endoftext|> y"]
    path = default_vocabulary(name)
    library = tokenizers.Tokenizer.from_file(path)
    texts += [" ".join(rng.choice(["ab", "Ab.", "été,", "x<|endoftext|>y", "3", "a\nb", "--", "l'été"]) for _ in range(rng.randrange(30))) for _ in range(60)]
    encoder, merger = PieceEncoder(path, 20), token_counts.HeapMerger(path, 20) if name.startswith("word") else None
    for at in range(0, len(texts), 25):  # more pieces than the memo holds
        part = texts[at : at + 25]
        column, counts = encoder.encode(pa.array(part), 7)
        expected = [library.encode(text, add_special_tokens=False).ids for text in part]
        assert [np.frombuffer(ids, dtype="<u2").tolist() for ids in column.to_pylist()] == [[*ids, 7] for ids in expected]
        assert counts.tolist() == [len(ids) + 1 for ids in expected]
        assert merger is None or merger.count(pa.array(part)).tolist() == [len(ids) for ids in expected]


@pytest.mark.parametrize("crowd", [1, 3, 1000])
def test_repeats_equal_brute_force(docs, rows, none, crowd):
    length = 60
    got = run_index.without_repeats(docs, length, 12, crowd, 3000).collect()
    raws = [(r[1] or "").encode() for r in rows]
    seen = {}
    for k, raw in enumerate(raws):
        for i in range(len(raw) - length + 1):
            seen.setdefault(raw[i : i + length], []).append((k, i))
    gone = [np.zeros(len(r), dtype=bool) for r in raws]
    for found in seen.values():
        if len(found) > 1:
            for k, i in found:
                gone[k][i : i + length] = True
    expected = sorted((r[0] if r[0] is not None else -1, len(raw), int(g.sum()), int((np.diff(np.append(0, g.astype(int))) == 1).sum()), np.frombuffer(raw, np.uint8)[~g].tobytes()) for r, raw, g in zip(rows, raws, gone, strict=True))
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got) == expected
    if crowd == 1:
        assert run_index.without_repeats(none, length, 12).count() == 0


def test_the_edges_of_a_common_passage(spark):
    """Many documents hold a passage between texts of their own: its edges make crowded grams."""
    rng = random.Random(19)
    letters = lambda n: "".join(rng.choice("abcdef ") for _ in range(n))
    passage = letters(90)
    raws = [letters(rng.randrange(80)) + passage + letters(rng.randrange(80)) for _ in range(60)] + [letters(150) for _ in range(5)]
    raws += [raws[0][: len(raws[0]) // 2] + letters(50), raws[3]]
    length, seen = 60, {}
    for k, raw in enumerate(raws):
        for i in range(len(raw) - length + 1):
            seen.setdefault(raw[i : i + length], []).append((k, i))
    gone = [[False] * len(raw) for raw in raws]
    for places in seen.values():
        for k, i in places if len(places) > 1 else ():
            gone[k][i : i + length] = [True] * length
    expected = [(k, "".join(c for c, x in zip(raw, gone[k], strict=True) if not x)) for k, raw in enumerate(raws)]
    docs = spark.createDataFrame(list(enumerate(raws)), "doc_id long, text string").repartition(3)
    for crowd in (2, 10):
        got = run_index.without_repeats(docs, length, 12, crowd, 3000).collect()
        assert sorted((r["doc_id"], bytes(r["kept"]).decode()) for r in got) == expected


def test_suffix_array_and_streamed_matches():
    rng = random.Random(4)
    strings = list({bytes(rng.choice(b"ab") for _ in range(rng.randrange(5, 60))) for _ in range(12)})
    index = run_index.RunIndex(strings)
    got, at = index.matching_statistics(), 0
    everything = [(k, i) for k, s in enumerate(strings) for i in range(len(s))]
    assert index.lengths.sum() == len(index.data)
    for k, s in enumerate(strings):
        for i in range(len(s)):
            best = max(len(os.path.commonprefix([s[i:], strings[m][j:]])) for m, j in everything if (m, j) != (k, i))
            assert got[at + i] == best
        at += len(s) + 1


def _near_expected(rows, width, percent):
    sets = {}
    for r in rows:
        if r[0] is None:
            continue
        words = (r[1] or "").encode().lower().split()
        found = {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or ({tuple(words)} if words else set())
        sets[r[0]] = found
    parent = {d: d for d in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(s), top(d)) for d, s in sets.items()}


@pytest.mark.parametrize("block", [512, 2])
def test_near_duplicates_equal_all_pairs(spark, docs, rows, none, monkeypatch, block):
    monkeypatch.setattr(near_dups, "BLOCK", block)
    got = near_dups.near_duplicates(docs).collect()
    expected = _near_expected(rows, 2, 80)
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == {(d, *v) for d, v in expected.items()}
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got) and len(got) == len(rows)
    if block == 2:
        assert near_dups.near_duplicates(none).count() == 0


def test_rows_of_one_id_share_their_links(spark):
    rng = random.Random(12)
    a, b, c = (" ".join(f"{k}{rng.randrange(400)}" for _ in range(120)) for k in "abc")
    rows = [(1, a), (1, b), (2, a + " tail"), (3, b + " tail"), (4, c), (4, c), (5, c), (6, "lone words"), (None, a), (7, None)]
    got = near_dups.near_duplicates(spark.createDataFrame([(*r, *[None] * 8) for r in rows], SCHEMA).repartition(3))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7, None: None}
    assert got.count() == len(rows)


def test_recall_of_pairs_just_above_the_threshold(spark):
    """Every pair of similarity 0.8 to 0.86 is linked: none of 240 is lost to the bands."""
    rng = random.Random(77)
    rows, alike = [], []
    for i in range(240):
        words = [f"w{rng.randrange(100_000)}" for _ in range(rng.randrange(60, 300))]
        copy, pairs = list(words), lambda w: {tuple(w[j : j + 2]) for j in range(len(w) - 1)}
        while True:
            edited = list(copy)
            edited[rng.randrange(len(edited))] = f"e{rng.randrange(100_000)}"
            if 100 * len(pairs(edited) & pairs(words)) < 80 * len(pairs(edited) | pairs(words)):
                break
            copy = edited
        similarity = len(pairs(copy) & pairs(words)) / len(pairs(copy) | pairs(words))
        assert 0.8 <= similarity < 0.86
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(copy))]
    got = near_dups.near_duplicates(spark.createDataFrame([(*r, *[None] * 8) for r in rows], SCHEMA).repartition(4))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {d: d - d % 2 for d, _ in rows}


def test_chains_of_copies_need_the_second_round(spark):
    words = [f"w{i}" for i in range(100)]
    chain = []
    for step in range(14):  # neighbours are alike, ends are not
        words = words[3:] + [f"n{step}{j}" for j in range(3)]
        chain.append((step, " ".join(words), *[None] * 8))
    got = near_dups.near_duplicates(spark.createDataFrame(chain, SCHEMA))
    assert {r["component_id"] for r in got.collect()} == {0}


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(9)] + [(100, j) for j in range(101, 120)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(10), 0), **dict.fromkeys(range(100, 120), 100)}


def test_hubs_are_joined_like_other_nodes(spark, monkeypatch):
    from rootweave.llm import components as module

    monkeypatch.setattr(module, "HUBS", 8)
    rng = random.Random(3)
    edges = [(500, j) for j in range(400)] + [(rng.randrange(600, 900), rng.randrange(600, 900)) for _ in range(200)] + [(399, 600)]
    parent = {x: x for e in edges for x in e}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in edges:
        parent[max(top(x), top(y))] = min(top(x), top(y))
    looped = {x for x in parent if all(x not in e or e[0] == e[1] for e in edges)}
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for x in parent if x not in looped}


def _viterbi(model, observations):
    """The best path of one sequence, by the recurrence."""
    at, came = chat.opening(), []
    for row in model.scores(np.array(observations, dtype=int).reshape(-1, 4)):
        options = at[:, None] + model.move
        came.append(options.argmax(axis=0))
        at = options.max(axis=0)
        at[: chat.STATES] += row
    state, path = int(at.argmax()), []
    for back in reversed(came):
        path.append(state)
        state = int(back[state])
    return path[::-1]


def _expected_turns(model, blocks):
    """Turns of one conversation, [(turn, text)] in order, from the whole path."""
    lines = [(turn, i, line, blanks) for turn, text in blocks for i, line, blanks in chat.observed(text)]
    path = _viterbi(model, [chat.features(line, blanks > 0) for _, _, line, blanks in lines])
    turns = []
    for (turn, i, line, blanks), state in zip(lines, path, strict=True):
        if state % 2 == 0:
            turns.append([turn, i, chat.ROLES[state // 2], chat.without_marker(line), 1])
        else:
            turns[-1][3] += "\n" * (blanks + 1) + line
            turns[-1][4] += 1
    return [(t, i, role, text.lstrip("\n"), f"<|{role}|>\n" + text.lstrip("\n") + "\n<|end|>\n") for t, i, role, text, _ in turns]


def test_roles_are_recovered(spark, none):
    if not os.path.isdir(SMALL):
        pytest.skip("no test tables")
    turns = spark.read.parquet(f"{SMALL}/conversations.parquet")
    blocks = chat.ordered(chat.raw_blocks(turns))
    held = language.held_out(F.col("conv_id"))
    model = chat.fit(blocks, ~held)
    found = chat.parse_transcripts(blocks, model).collect()
    truth = {(r["conv_id"], r["turn"]): r["role"] for r in turns.filter(held).collect()}
    got = {}
    for r in found:
        got.setdefault((r["conv_id"], r["turn"]), r["role"])
    assert np.mean([got.get(k) == role for k, role in truth.items()]) > 0.9
    # every conversation as by Viterbi over the whole of it, whatever the segments
    of_conv = {}
    for r in blocks.orderBy("n").collect():
        of_conv.setdefault(r["conv_id"], []).append((r["turn"], r["text"]))
    expected = sorted((c, *t) for c, own in of_conv.items() for t in _expected_turns(model, own))
    assert sorted((r["conv_id"], r["turn"], r["line"], r["role"], r["text"], r["rendered"]) for r in found) == expected
    small = chat.parse_transcripts(blocks, model, span=2, fan=2, group_bytes=3000).collect()
    assert sorted((r["conv_id"], r["turn"], r["line"], r["role"], r["text"], r["rendered"]) for r in small) == expected
    by_query = queries.op5_chat_roles(spark, SMALL).collect()
    assert sorted((r["conv_id"], r["turn"], r["line"], r["role"], r["rendered_sha256"]) for r in by_query) == sorted((c, t, i, role, hashlib.sha256(x.encode()).hexdigest()) for c, t, i, role, _, x in expected)


def test_odd_transcripts(spark):
    log = lambda rows: np.log(np.array(rows, dtype=float))
    with np.errstate(divide="ignore"):
        move = log([[0.2, 0.4, 0.2, 0, 0.2, 0, 0], [0.2, 0.4, 0.2, 0, 0.2, 0, 0], [0.2, 0, 0.2, 0.4, 0.2, 0, 0], [0.2, 0, 0.2, 0.4, 0.2, 0, 0], [0.2, 0, 0.2, 0, 0.2, 0.4, 0], [0.2, 0, 0.2, 0, 0.2, 0.4, 0], [1 / 3, 0, 1 / 3, 0, 1 / 3, 0, 0]])
        marker = log([[0.1 if m == 0 else 0.8 if m == s // 2 + 1 and s % 2 == 0 else 0.02 for m in range(5)] if s % 2 == 0 else [0.9, 0.025, 0.025, 0.025, 0.025] for s in range(6)])
    model = chat.TurnModel(move, [marker, *(np.zeros((6, n)) for n in chat.FEATURES[1:])])
    rows = [(1, -5, "User: first para\n\nsecond para\n"), (1, -2, "Assistant:\n\nan answer\n\n\nits end"), (1, None, "System: before all"), (2, 0, ""), (2, 1, None), (3, 0, "User: a"), (3, 0, "User: a"), (3, 0, "User: b"), (None, 0, "User: alone"), (None, 0, "Assistant: alone too"), (4, 0, "User: x"), (4, 1, "more " * 3000 + "\n" + "line\n" * 2000), (4, 2, "\ntail of it"), (4, 3, "Assistant: y")]
    frame = spark.createDataFrame([(*r, "x", 7) for r in rows], "conv_id long, turn long, text string, seg string, n_lines int").repartition(3)
    results = []
    for span, fan in ((1024, 256), (1, 2), (2, 2)):
        found = chat.parse_transcripts(frame.select("conv_id", "turn", "text"), model, span, fan).collect()
        results.append(sorted((str(r["conv_id"]), -99 if r["turn"] is None else r["turn"], r["line"], r["role"], r["text"]) for r in found))
    assert results[0] == results[1] == results[2]
    texts = {(c, t): text for c, t, _, _, text in results[0]}
    assert texts["1", -5] == "first para\n\nsecond para" and texts["1", -2] == "an answer\n\n\nits end" and texts["1", -99] == "before all"
    assert sorted(t for c, _, _, _, t in results[0] if c in ("3", "None")) == ["a", "a", "alone", "alone too", "b"]
    assert texts["4", 0].startswith("x\nmore more") and texts["4", 0].endswith("line\n\ntail of it") and not any(c == "2" for c, *_ in results[0])
    assert chat.parse_transcripts(frame.limit(0).select("conv_id", "turn", "text"), model).count() == 0


def test_rank_codes_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        ranks = (rng.integers(0, 1 << 32, n, dtype=np.uint64) >> rng.integers(0, 32, n, dtype=np.uint64)).astype("<u4")
        control, data = token_files.pack_ranks(ranks)
        assert (token_files.unpack_ranks(control, data, n) == ranks).all()


def test_token_files_round_trip(docs, rows, none):
    path = default_vocabulary("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    files = token_files.write_token_files(docs, path, 0)
    got = files.index().collect()
    assert len(got) == len(rows)
    ids = {r[0]: np.array([*library.encode(r[1] or "", add_special_tokens=False).ids, 0], dtype="<u4") for r in rows}
    ordered = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] for r in ordered] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d))
    at = 0
    for r in ordered:
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids[r["doc_id"]]), zlib.crc32(ids[r["doc_id"]].tobytes()))
        at += r["n_tokens"]
    assert token_files.write_token_files(none, path).index().count() == 0


def test_starts_are_places_in_the_files_for_repeated_ids(spark):
    path = default_vocabulary("byte_bpe_50k.json")
    rng = random.Random(8)
    rows = [(d, _text(rng, rng.randrange(12)), *[None] * 8) for d in [3] * 40 + [1, 2, 4] + [None] * 5]
    files = token_files.write_token_files(spark.createDataFrame(rows, SCHEMA).repartition(4), path, 0)
    of_rank, stream = files.id_of(), []
    stored = sorted(files.read().collect(), key=lambda r: (r["part"], r["start"]))
    for r in stored:
        stream.append(of_rank[token_files.unpack_ranks(r["control"], r["data"], r["n_tokens"])])
    ids = [r["doc_id"] for r in stored]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))
    whole = np.concatenate(stream)
    for r in files.index().collect():
        assert zlib.crc32(whole[r["start"] : r["start"] + r["n_tokens"]].tobytes()) == r["ids_crc32"]
    library = tokenizers.Tokenizer.from_file(path)
    expected = sorted((str(r[0]), [*library.encode(r[1], add_special_tokens=False).ids, 0]) for r in rows)
    assert sorted((str(d), x.tolist()) for d, x in zip(ids, stream, strict=True)) == expected


@pytest.mark.parametrize("batches", [1, 5])
def test_line_dedup_equals_brute_force(docs, rows, none, batches):
    blanks = " \t\n\x0b\f\r"
    fold = lambda x: "".join(c.lower() if c in line_runs._UPPER else c for c in x.strip(blanks))
    holders = {}
    for k, r in enumerate(rows):
        for line in (r[1] or "").split("\n"):
            holders.setdefault(fold(line), {})[k] = r[0]
    expected = []
    for r in rows:
        kept = []
        for line in (r[1] or "").split("\n"):
            who = holders[fold(line)]
            last = max((d for d in who.values() if d is not None), default=None)
            kept += [line] if len(fold(line)) < 20 or len(who) < 3 or r[0] == last else []
        n = (r[1] or "").count("\n") + 1
        expected.append((str(r[0]), n, n - len(kept), "\n".join(kept)))
    got = line_runs.dedup_lines(docs, batches=batches, fanout=2, carry=batches == 1)
    assert sorted((str(r["doc_id"]), r["n_lines"], r["n_dropped"], r["kept"]) for r in got.collect()) == sorted(expected)
    if batches == 1:
        assert line_runs.dedup_lines(none).count() == 0


def test_language_by_centroids(spark, docs):
    if not os.path.isdir(SMALL):
        pytest.skip("no test tables")
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = queries.op8_language_id(spark, SMALL).join(table.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in found]) > 0.97
    model = language.fit(table, F.lit(True))
    odd = _by_id(language.predict(docs, model))
    assert odd[22]["lang_pred"] == odd[23]["lang_pred"] == odd[24]["lang_pred"] == "und" and odd[22]["score"] == 0
    assert language.accepted(table, model).count() == table.count()
    assert language.accepted(table, model).columns == table.columns
    strange = spark.createDataFrame([(1, "日本語の文章はここにありますから認識されません" * 3)], "doc_id long, text string")
    assert language.predict(strange, model).first()["rejected"]
    with pytest.raises(ValueError):
        language.fit(table, F.lit(False))


def test_vectors_and_choice_equal_brute_force(spark):
    rng = random.Random(23)
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 30))), lang) for lang, words in (("x", WORDS[:12]), ("y", WORDS[12:])) for i in range(60)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), F.lit(True), bits=10)
    learned = [t for _, t, _ in rows if zlib.crc32(t.encode()) % 4 != 3]
    bag = lambda t: {g: n for g, n in zip(*np.unique(language.grams(t, 10), return_counts=True), strict=True)}
    holders = {}
    for t in learned:
        for g in bag(t):
            holders[g] = holders.get(g, 0) + 1
    idf = {g: np.log((1 + len(learned)) / (1 + holders.get(g, 0))) + 1 for g in range(1 << 10)}

    def vector(t):
        raw = {g: np.log1p(n) * idf[g] for g, n in bag(t).items()}
        norm = sum(x * x for x in raw.values()) ** 0.5
        return {g: x / norm for g, x in raw.items()}

    texts = [t for _, t, _ in rows[::7]] + ["alpha omega", "neither of them", "Zeta, ETA!"]
    labels, scores, _ = model.predict(texts)
    for t, label, score in zip(texts, labels, scores, strict=True):
        cosines = [sum(x * c[g] for g, x in vector(t).items()) for c in model.centroids]
        assert abs(score - min(1, max(cosines))) < 1e-4
        assert label == model.labels[int(np.argmax(cosines))]
    for label in ("x", "y"):  # a centroid is the unit sum of the texts nearest to it
        own = [t for _, t, lang in rows if lang == label and t in learned]
        centres = [c for c, name in zip(model.centroids, model.labels, strict=True) if name == label]
        near = [int(np.argmax([sum(x * c[g] for g, x in vector(t).items()) for c in centres])) for t in own]
        for j, c in enumerate(centres):
            total = np.zeros(1 << 10)
            for t, k in zip(own, near, strict=True):
                for g, x in vector(t).items() if k == j else ():
                    total[g] += x
            assert float(total @ c / np.linalg.norm(total)) > 0.99


@pytest.mark.parametrize("times", [1, 3])
def test_wrongly_labelled_garbage_is_rejected_and_short_documents_stay(spark, times):
    import corpus_pipeline as cp

    rng = random.Random(17)
    stems = {"aa": "ka mi to ren sol ba ne lu".split(), "bb": "schra pfe wint gor zug elt ach und".split()}
    word = lambda lang: "".join(rng.choice(stems[lang]) for _ in range(rng.randrange(1, 4)))
    noise = lambda: "".join(rng.choice("bcdfghjklmnpqrstvwxyz") for _ in range(rng.randrange(2, 10)))
    clean = [(" ".join(word(lang) for _ in range(rng.randrange(5, 200))), lang) for lang in stems for _ in range(150 * times)]
    short = [(" ".join(word(lang) for _ in range(3)), lang) for lang in stems for _ in range(10 * times)]
    odd = [(" ".join(noise() for _ in range(rng.randrange(10, 200))), lang) for lang in stems for _ in range(2 * times)]
    odd += [("日本語の文章はここにありますから認識されません", "aa"), ("Мой дядя самых честных правил, когда не в шутку занемог", "bb")] * times
    rows = [(i, *r) for i, r in enumerate(clean + short + odd)]
    kept = cp.language_id(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), "")
    assert {r["doc_id"] for r in kept.collect()} == set(range(len(clean + short)))


def test_a_much_repeated_row_counts_once(spark):
    rng = random.Random(5)
    rows = [(k, _text(rng, 30), "en" if k % 2 else "de") for k in range(400)] + [(7, "the same row again and again", "en")] * 3000
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = [language.fit(table.repartition(n), F.lit(True), per_language=100) for n in (3, 5)]
    assert models[0].labels == models[1].labels and np.allclose(models[0].centroids, models[1].centroids, atol=1e-5) and np.allclose(models[0].limits, models[1].limits, atol=1e-5)


@pytest.mark.parametrize("rows", [[], [(1, "no label", None), (2, None, "en"), (3, "12 !", "en")]])
def test_nothing_labelled_has_a_defined_result(spark, tmp_path, rows):
    import corpus_pipeline as cp

    docs = spark.createDataFrame([(*r, "web", None) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = {(r["doc_id"], r["lang_pred"], r["score"]) for r in queries.op8_language_id(spark, str(tmp_path)).collect()}
    assert found == {(r[0], "und", 0.0) for r in rows}
    assert [r["doc_id"] for r in cp.language_id(spark, docs, str(tmp_path)).collect()] == [1][: len(rows)]


def test_contamination_by_alignment(spark, docs, none):
    rng = random.Random(9)
    item = [f"q{rng.randrange(500)}" for _ in range(30)]
    edited = list(item)
    edited[5], edited[14] = "changed", "Other,"
    del edited[20]
    clean = [f"z{rng.randrange(500)}" for _ in range(60)]
    rows = [(1, " ".join(clean + item + clean)), (2, " ".join(clean + [w.upper() + "." for w in edited])), (3, " ".join(clean)), (4, None), (5, " ".join(clean + item[:6] + clean)), (1, " ".join(item))]
    table = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(7, " ".join(item)), (8, None), (9, "too short"), (10, " ".join(item))], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(table, items).collect()}
    assert got == {(1, 7), (1, 10), (2, 7), (2, 10)}
    assert [r["doc_id"] for r in decontam.decontaminated(table, items).orderBy("doc_id").collect()] == [3, 4, 5]
    assert decontam.contaminated(table, items.limit(0)).count() == 0
    assert decontam.contaminated(none, items).count() == 0


def _held(docs, items, threshold=0.5):
    """Pairs by alignment of all documents with all items, whole."""
    numbers = {}
    code = lambda text: np.array([numbers.setdefault(w, len(numbers)) for w in decontam.words_of(text)], dtype=np.int64)
    items = {k: code(t) for k, t in items.items()}
    shares = {(d, k): decontam.smith_waterman(item, words)[0] / (2 * len(item)) for d, words in ((d, code(t)) for d, t in docs.items()) for k, item in items.items() if len(words)}
    return {pair: share for pair, share in shares.items() if share >= threshold}


def test_edited_copies_are_found_as_by_aligning_all_pairs(spark):
    rng = random.Random(31)
    common = [f"w{i}" for i in range(30)]
    prose = lambda n: [rng.choice(common) for _ in range(n)]
    items = {k: [rng.choice([f"q{rng.randrange(300)}", rng.choice(common)]) for _ in range(rng.randrange(16, 60))] for k in range(12)}
    docs = {}
    for k, item in items.items():
        broken = [[f"x{i}" if i % n == n - 1 else w for i, w in enumerate(item)] for n in (4, 5)]
        broken.append([f"x{i}" if i % 3 == 1 else w for i, w in enumerate(item)])
        stuffed = [[w for i, w in enumerate(item) for w in ([w, f"y{i}"] if i % n == n - 1 else [w])] for n in (2, 3)]
        short = [w for i, w in enumerate(item) if i % 3]
        # items of even number have no whole copy: the pairs that the edits destroy occur nowhere
        for copy in [*broken, *stuffed, short, item[: len(item) // 2 + 1]] + [item] * (k % 2):
            docs[len(docs)] = " ".join(prose(rng.randrange(80)) + copy + prose(rng.randrange(80)))
    for _ in range(20):
        docs[len(docs)] = " ".join(prose(300))
    texts = {k: " ".join(item) for k, item in items.items()}
    expected = _held(docs, texts)
    assert {k for _, k in expected} == set(items) and len(expected) > 3 * len(items)
    table = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    benchmark = spark.createDataFrame(list(texts.items()), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontam.contaminated(table, benchmark).collect()}
    assert got == expected
    kept = {r["doc_id"] for r in decontam.decontaminated(table, benchmark).collect()}
    assert kept == set(docs) - {d for d, _ in expected}


def test_items_of_one_or_two_words_are_found(spark):
    docs = spark.createDataFrame([(1, "see Zanzibar, there"), (2, "a wet umbrella stand"), (3, "stand umbrella zan zibar"), (4, "wet"), (5, "umbrella"), (6, "one two three four")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "Zanzibar"), (2, "umbrella stand"), (3, "one two three four"), (4, " ... ")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"], r["score"]) for r in decontam.contaminated(docs, items).collect()}
    assert found == {(1, 1, 1.0), (2, 2, 1.0), (6, 3, 1.0)}
    assert {r["doc_id"] for r in decontam.decontaminated(docs, items).collect()} == {3, 4, 5}
    # an empty text after the last words of a batch takes no gram from them
    ends = spark.createDataFrame([(1, "an umbrella stand"), (2, "")], "doc_id long, text string").coalesce(1)
    assert [r["doc_id"] for r in decontam.contaminated(ends, items).collect()] == [1]


def test_alignment_equals_the_recurrence():
    rng = random.Random(6)
    for _ in range(30):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(1, 15))] for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                table[i, j] = max(0, table[i - 1, j - 1] + (2 if x == y else -1), table[i - 1, j] - 1, table[i, j - 1] - 1)
        assert decontam.smith_waterman(np.array(a), np.array(b))[0] == table.max()


def test_packing_is_whole_and_gapless(docs, rows, none):
    path = default_vocabulary("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    size = 256
    got = packing.pack(docs, path, 1, size, bin_chars=20_000).collect()
    ids = {r[0]: np.array([*library.encode(r[1] or "", add_special_tokens=False).ids, 1], dtype="<u4") for r in rows}
    covered = {d: np.zeros(len(x), dtype=int) for d, x in ids.items()}
    by_sequence = {}
    for p in got:
        part = ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert p["ids_crc32"] == zlib.crc32(part.tobytes()) and p["doc_tokens"] == len(ids[p["doc_id"]])
        covered[p["doc_id"]][p["start"] : p["start"] + p["length"]] += 1
        by_sequence.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    times = {d: sum(r[0] == d for r in rows) for d in ids}
    assert all((c == times[d]).all() for d, c in covered.items())
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size and at & (at - 1) == 0
    assert packing.pack(none, path).count() == 0


def test_windows_keep_the_mixture():
    queues = {"a": packing.deque([400] * 30), "b": packing.deque([100] * 40), "c": packing.deque([7] * 100)}
    total = sum(sum(q) for q in queues.values())
    share = {k: sum(q) / total for k, q in queues.items()}
    taken = {}
    for window, key, take in packing.deficit_round_robin(queues, share, dict.fromkeys(queues, 0.0), 256):
        taken.setdefault(window, dict.fromkeys(queues, 0))[key] += take
    for window, parts in taken.items():
        so_far = {k: sum(taken[w][k] for w in range(window + 1)) for k in queues}
        assert all(abs(so_far[k] - share[k] * sum(so_far.values())) <= len(queues) for k in queues)
        assert sum(parts.values()) in (256, total % 256)


def test_a_quantum_bounds_turns_and_deviation():
    rng = random.Random(21)
    queues = {k: packing.deque(rng.randrange(1, 900) for _ in range(rng.randrange(5, 60))) for k in range(20)}
    total = {k: sum(q) for k, q in queues.items()}
    share = {k: n / sum(total.values()) for k, n in total.items()}
    turns = list(packing.deficit_round_robin(queues, share, dict.fromkeys(queues, 0.0), 1024, 64))
    so_far, filled = dict.fromkeys(queues, 0), 0
    for window in range(turns[-1][0] + 1):
        own = [(k, n) for w, k, n in turns if w == window]
        assert len(own) <= 1024 // 64 + len(queues) and (sum(n for _, n in own) == 1024 or window == turns[-1][0])
        for k, n in own:
            so_far[k] += n
            filled += n
        assert all(abs(so_far[k] - share[k] * filled) <= 2 * 64 for k in queues)
    assert so_far == total


def test_a_target_mixture_and_repeated_rows(spark):
    path = default_vocabulary("word_bpe_49k.json")
    rng = random.Random(30)
    rows = [(d, _text(rng, 60), s) for d, s in enumerate(["a", "b", None] * 40)] + [(7, "same text again", "a")] * 200
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = packing.pack(docs, path, 1, 128, target={"a": 1.0, None: 3.0}, bin_chars=3000).collect()
    library = tokenizers.Tokenizer.from_file(path)
    ids = [len(library.encode(t, add_special_tokens=False).ids) + 1 for _, t, _ in rows]
    assert sum(p["length"] for p in got) == sum(ids) and sum(p["start"] == 0 for p in got) == len(rows)
    assert sorted({p["sequence_id"] for p in got}) == list(range(max(p["sequence_id"] for p in got) + 1))


def test_pipeline_on_whole_tables(spark):
    if not os.path.isdir(SMALL):
        pytest.skip("no test tables")
    import corpus_pipeline as cp

    assert [n for n, _ in cp.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "packing"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    sizes = [docs.count()]
    for _, stage in cp.STAGES[:4]:
        new = cp.written(stage(spark, docs, SMALL), "test-stage")
        assert new.dtypes == docs.dtypes
        docs = new
        sizes.append(docs.count())
    assert sizes[1] == sizes[2] == sizes[0] and sizes[4] < sizes[3] < sizes[2]
    packed = cp.packing(spark, docs, SMALL)
    assert packed.select("doc_id").distinct().count() == docs.count()
    shas = {hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in docs.filter("text <> ''").collect()}
    assert len(shas) == docs.filter("text <> ''").count()


def _planted(rng):
    """Clean documents in two languages with copies, edited copies, shared lines, benchmark passages, and odd rows."""
    stems = {"en": "the of ing ton ware light sea wind".split(), "de": "sch ung lich kraft zeit bau werk tag".split()}
    word = lambda lang: "".join(rng.choice(stems[lang]) for _ in range(rng.randrange(1, 4)))
    prose = lambda lang, n: [word(lang) for _ in range(n)]
    items = {k: " ".join(f"quiz{rng.randrange(90)}" if i % 2 else word("en") for i in range(25)) for k in range(3)}
    texts = [(" ".join(prose(lang, rng.randrange(60, 200))), lang) for lang in stems for _ in range(120)]
    footer = "All rights to this page are reserved by its owner"
    texts += [(t + "\n" + footer, lang) for t, lang in texts[:5]]
    texts[0] = (texts[0][0] + "\n" + footer, "en")
    for t, lang in texts[10:20]:
        words = t.split(" ")
        texts += [(t, lang), (" ".join([*words[:30], "changed", *words[31:]]), lang)]
    for k, item in items.items():
        texts += [(" ".join(prose("en", 40)) + " " + item + " " + " ".join(prose("en", 40)), "en"), (item.replace("quiz", "Quiz", 3), "en")]
    texts += [(None, "en"), ("", None), ("12 34 !", "en"), ("日本語の文章はここにありますから認識されません" * 4, "en")]
    rows = [(i, t, lang, rng.choice(["web", "web", "book", None]), len(t or ""), "x") for i, (t, lang) in enumerate(texts)]
    return rows, items


def test_every_stage_equals_brute_force(spark, tmp_path):
    import corpus_pipeline as cp

    rng = random.Random(41)
    rows, items = _planted(rng)
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, state = spark.read.parquet(f"{tmp_path}/documents.parquet"), {r[0]: r[1] for r in rows}
    stages = dict(cp.STAGES)

    def step(name):
        nonlocal docs
        docs = cp.written(stages[name](spark, docs, str(tmp_path)), f"test-{name}")
        assert docs.columns == [f.split()[0] for f in schema.split(", ")]
        return {r["doc_id"]: r["text"] for r in docs.collect()}

    state = {d: t for d, t in state.items() if t and any(map(str.isalpha, t)) and "日" not in t}
    assert step("language_id") == state

    holders = {}
    fold = lambda line: line.strip(" \t\n\x0b\f\r").lower()
    for d, t in state.items():
        for line in t.split("\n"):
            holders.setdefault(fold(line), set()).add(d)
    gone = lambda d, line: len(fold(line)) >= 20 and len(holders[fold(line)]) >= 3 and d != max(holders[fold(line)])
    state = {d: "\n".join(x for x in t.split("\n") if not gone(d, x)) for d, t in state.items()}
    assert step("line_dedup") == state
    assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())

    groups = _near_expected([(d, t) for d, t in state.items()], 5, 80)
    before = len(state)
    state = {d: t for d, t in state.items() if groups[d][1] == d}
    assert step("near_dedup") == state and len(state) <= before - 20

    found = _held({d: t for d, t in state.items()}, items)
    assert len({d for d, _ in found}) == 6
    state = {d: t for d, t in state.items() if d not in {d for d, _ in found}}
    assert step("decontamination") == state

    library = tokenizers.Tokenizer.from_file(default_vocabulary("word_bpe_49k.json"))
    ids = {d: np.array([*library.encode(t, add_special_tokens=False).ids, 1], dtype="<u4") for d, t in state.items()}
    pieces = cp.packing(spark, docs, str(tmp_path)).collect()
    for p in pieces:
        assert p["ids_crc32"] == zlib.crc32(ids[p["doc_id"]][p["start"] : p["start"] + p["length"]].tobytes())
    for d, own in ids.items():
        parts = sorted((p["start"], p["length"]) for p in pieces if p["doc_id"] == d)
        assert [a for a, _ in parts] == [0, *np.cumsum([n for _, n in parts]).tolist()[:-1]] and sum(n for _, n in parts) == len(own)
    again = cp.run(spark, str(tmp_path))
    assert sum(r["length"] for r in again.collect()) == sum(map(len, ids.values()))


def test_an_empty_corpus_goes_through_all_stages(spark, tmp_path):
    import corpus_pipeline as cp

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
    spark.createDataFrame([(1, None, None, None, None), (None, "some words here", None, None, None)], schema).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert [r["doc_id"] for r in cp.run(spark, str(tmp_path)).collect()] == [None]


@pytest.mark.parametrize("name", ["op4_near_dups", "op7_line_dedup"])
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SMALL):
        pytest.skip("no test tables")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SMALL}/documents.parquet')")
    expected = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in expected.description]
    found = queries.queries()[name](spark, SMALL).select(*columns).collect()
    assert sorted(map(tuple, found)) == sorted(expected.fetchall())


def test_token_queries_equal_the_library(spark):
    if not os.path.isdir(SMALL):
        pytest.skip("no test tables")
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    byte, word = (tokenizers.Tokenizer.from_file(default_vocabulary(f"{n}.json")) for n in ("byte_bpe_50k", "word_bpe_49k"))
    counts, files, at = _by_id(queries.op2_token_counts(spark, SMALL)), _by_id(queries.op6_token_files(spark, SMALL)), 0
    pieces = {}
    for p in queries.op10_packing(spark, SMALL).collect():
        pieces.setdefault(p["doc_id"], []).append(p)
    for r in rows:
        text = r["text"] or ""
        n = len(word.encode(text, add_special_tokens=False).ids)
        assert (counts[r["doc_id"]]["n_tokens"], counts[r["doc_id"]]["over_limit"]) == (n, n > 2048)
        ids = np.array([*byte.encode(text, add_special_tokens=False).ids, 0], dtype="<u4")
        f = files[r["doc_id"]]
        assert (f["start"], f["n_tokens"], f["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
        assert sum(p["length"] for p in pieces[r["doc_id"]]) == n + 1


def test_repeats_query_equals_brute_force(spark):
    if not os.path.isdir(SMALL):
        pytest.skip("no test tables")
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    raws = {r["doc_id"]: (r["text"] or "").encode() for r in rows}
    seen = {}
    for d, raw in raws.items():
        for i in range(len(raw) - 399):
            seen.setdefault(hash(raw[i : i + 400]), []).append((d, i))
    gone = {d: np.zeros(len(raw), dtype=bool) for d, raw in raws.items()}
    for places in seen.values():
        for d, i in places if len(places) > 1 else ():
            gone[d][i : i + 400] = True
    for r in queries.op3_repeats(spark, SMALL).collect():
        g = gone[r["doc_id"]]
        spans = int((np.diff(np.append(0, g.astype(int))) == 1).sum())
        left = np.frombuffer(raws[r["doc_id"]], np.uint8)[~g].tobytes()
        assert (r["n_removed"], r["n_spans"], r["kept_sha256"]) == (int(g.sum()), spans, hashlib.sha256(left).hexdigest())
