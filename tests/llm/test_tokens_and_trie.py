"""Alignment, packing and the prefix trie against plain versions, with nulls, empty and long texts, ties, repeats, empty tables,
hot groups and columns that clash."""

import bisect
import collections
import hashlib
import itertools
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import alignment, packing, prefix_trie
from loomgraph.llm.vocabularies import ByteLevel, read

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = [None, "", " ", "a", "a  b", " x", "tab\tand\nline ", "é ü ß ñ", "日本語 text", "x" * 5000, "▁ x", "ﬁ ligature", "<s> </s> <unk> <0x0A>", "<|endoftext|> a", "it's we'll I'M", "1234 5,6", "🙂🙂 end", " nbsp em", "\x00\x01", "a\r\n\r\n  b"]


def prose(rng, n):
    return " ".join("".join(rng.choice(["ka", "lo", "mir", "ten", "su", "é", "or,", "qui.", "D", "7"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    return ODD + [prose(rng, rng.randint(1, 120)) for _ in range(60)] + [prose(rng, 9000)] + [prose(rng, 30)] * 40


@pytest.fixture(scope="module")
def library():
    both = [tokenizers.Tokenizer.from_file(A), tokenizers.Tokenizer.from_file(A)]
    both[0].encode_special_tokens = True
    return both


@pytest.fixture(scope="module")
def encoders():
    return [ByteLevel(read(A), special=special) for special in (False, True)]


@given(st.text(max_size=60) | st.text(alphabet=" \t\n ab'sl1.,é<|endoftext|>", max_size=60))
@settings(max_examples=200, deadline=None)
def test_ids_equal_the_librarys(library, encoders, text):
    for codec, own in zip(library, encoders):
        assert own.ids(text) == codec.encode(text, add_special_tokens=False).ids


# -- alignment --------------------------------------------------------------------------------------------------------
def plain_alignment(texts, library):
    """Tokens as (id, from, to), groups and links by comparing byte ranges."""
    piece = sentencepiece.SentencePieceProcessor(model_file=B)
    level = ByteLevel(read(A), special=False)
    all_links, rows = [], []
    for text in texts:
        a, b = [], []
        if text:
            spans = lambda ids, entry: list(zip(ids, itertools.accumulate([0, *(len(entry(i)) for i in ids)]), itertools.accumulate(len(entry(i)) for i in ids)))
            b_entry = lambda i: bytes([int(piece.id_to_piece(i)[3:5], 16)]) if piece.is_byte(i) else piece.id_to_piece(i).replace("▁", " ").encode()
            a_ids, b_ids = library[0].encode(" " + text, add_special_tokens=False).ids, piece.encode(text)
            want = (" " + text).encode()
            if b"".join(level.entries[i] for i in a_ids) == want == b"".join(map(b_entry, b_ids)):
                a, b = spans(a_ids, level.entries.__getitem__), spans(b_ids, b_entry)
        ends = [[t[2] for t in some] for some in (a, b)]
        cuts = sorted({t[2] for t in a} & {t[2] for t in b})
        groups, done = [], [0, 0]
        for hi in cuts:
            inside = []
            for k, some in enumerate((a, b)):
                stop = bisect.bisect_right(ends[k], hi)
                inside.append(",".join(str(t[0]) for t in some[done[k] : stop]))
                done[k] = stop
            groups.append("|".join(inside))
        starts = np.array([t[1] for t in b])
        links = []
        for i, f, t in a:
            for j in range(max(int(np.searchsorted(starts, f, "right")) - 1, 0), len(b)):
                if b[j][1] >= t:
                    break
                if b[j][2] > f:
                    links.append((i, b[j][0]))
        all_links.append(links)
        rows.append((len(a), len(b), len(groups), len(links), ";".join(groups)))
    count = collections.Counter(itertools.chain(*all_links))
    most = collections.Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return [(*r[:4], sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(r[4].encode()).hexdigest() if r[0] else "") for r, links in zip(rows, all_links)], [r[4] for r in rows]


@pytest.mark.parametrize("block", [16_000_000, 4_000])
def test_alignment_against_byte_ranges(spark, texts, library, monkeypatch, block):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", block)
    monkeypatch.setattr(alignment, "SLICE_BYTES", 3_000)
    rows = [*enumerate(texts), (None, texts[30]), (31, texts[31])]
    want, _ = plain_alignment([t for _, t in rows], library)
    df = spark.createDataFrame([(i, t, "k", 0) for i, t in rows], "doc_id long, text string, block string, n_a int").repartition(3)
    got = alignment.aligned_documents(df, A, B)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter((i, *w) for (i, _), w in zip(rows, want))
    assert sum(w[0] == 0 for w in want) < len(want) / 4


def test_alignment_groups_and_edges(spark, texts, library):
    _, written = plain_alignment(texts, library)
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, groups int")
    got = {r.doc_id: ";".join(",".join(map(str, g.a)) + "|" + ",".join(map(str, g.b)) for g in r.groups) for r in alignment.alignments(df, A, B).collect()}
    assert got == dict(enumerate(written))
    assert alignment.aligned_documents(df.limit(0), A, B).count() == 0
    a, b, cut = alignment.owners(np.array([2, 1, 3]), np.array([1, 2, 3]))
    assert list(zip(a.tolist(), b.tolist(), cut.tolist())) == [(0, 0, True), (0, 1, False), (1, 1, False), (2, 2, True)]
    assert [len(x) for x in alignment.owners(np.zeros(0, int), np.zeros(0, int))] == [0, 0, 0]


# -- packing ----------------------------------------------------------------------------------------------------------
def test_fullest_against_enumeration():
    rng = random.Random(4)
    for _ in range(300):
        counts = {rng.randint(1, 14): rng.randint(1, 3) for _ in range(rng.randint(0, 5))}
        room = rng.randint(0, 40)
        sums = {sum(n * k for n, k in zip(counts, some)) for some in itertools.product(*(range(k + 1) for k in counts.values()))}
        got = packing.fullest(counts, room)
        assert all(0 < k <= counts[n] for n, k in got.items())
        assert sum(n * k for n, k in got.items()) == max(s for s in sums if s <= room)


@pytest.mark.parametrize("lengths", [[], [1], [5000], [1024, 2048], [700] * 500, [1023] * 7, list(range(1, 1500)), [3] * 1000 + [1022] * 10])
def test_windows_hold_each_id_once_without_padding(lengths):
    seen, short = collections.defaultdict(list), 0
    for pieces in packing.windows(lengths):
        size = sum(n for _, _, n in pieces)
        assert size & (size - 1) == 0 and size <= 1024
        short += size < 1024
        for item, start, n in pieces:
            seen[item].append((start, n))
    for item, length in enumerate(lengths):
        at = 0
        for start, n in sorted(seen[item]):
            assert start == at and n > 0
            at += n
        assert at == length
    assert short <= 10
    whole = sum(lengths) // 1024
    assert sum(map(len, seen.values())) <= len(lengths) + whole + sum(n // 1024 for n in lengths) + 10


def test_packing_rebuilds_every_document(spark, texts, library, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_TOKENS", 5_000)
    monkeypatch.setattr(packing, "SLICE_BYTES", 3_000)
    rows = [*enumerate(texts), (1000, texts[30])]
    df = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, start int").repartition(3)
    got = packing.packed_documents(df, A).collect()
    want = {i: [*library[1].encode(t or "", add_special_tokens=False).ids, 0] for i, t in rows}
    assert 50256 in want[ODD.index("<|endoftext|> a")]
    back, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        ids = np.frombuffer(r.ids, dtype="<u4").tolist()
        assert len(ids) == r.length and r.doc_tokens == len(want[r.doc_id])
        back[r.doc_id].append((r.start, ids))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert {i: sum((ids for _, ids in sorted(some)), []) for i, some in back.items()} == want
    for some in sequences.values():
        assert [o for o, _ in sorted(some)] == list(itertools.accumulate([0, *(n for _, n in sorted(some))]))[:-1]
        size = sum(n for _, n in some)
        assert size <= 1024 and size & (size - 1) == 0
    assert packing.packed_documents(df.limit(0), A).count() == 0
    nulls = packing.packed_documents(spark.createDataFrame([(None, None), (None, "a b")], "doc_id long, text string"), A).collect()
    assert {r.doc_tokens for r in nulls} == {1, 3} and sum(r.length for r in nulls) == 4


def test_packing_query_has_unsigned_checksums(spark, tmp_path):
    spark.createDataFrame([(1, "one two three"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in packing.op12_packing(spark, str(tmp_path)).collect()}
    ids = [*tokenizers.Tokenizer.from_file(A).encode("one two three").ids, 0]
    assert got[1].ids_crc32 == zlib.crc32(np.array(ids, dtype="<u4").tobytes()) and got[2].length == 1


# -- prefix trie ------------------------------------------------------------------------------------------------------
def plain_trie(rows, rebuild=True):
    said = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            said[c].append((turn is not None, turn or 0, role or "", text or ""))
    said = {c: [t[2:] for t in sorted(some)] for c, some in said.items()}
    whole = dict(said)
    if rebuild:
        for c in said:
            h = zlib.crc32(str(c).encode()) % 9
            whole[c] = said.get(c - c % 5, [])[:h] + said[c][h:]
    members = collections.defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[tuple(whole[c][:d])].append(c)
    children = collections.defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        saved[node] = sum(saved[x] for x in children[node]) + (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
    ends = lambda node: ",".join(str(c) for c in members[node] if len(whole[c]) == len(node))
    return collections.Counter(
        (members[n][0], len(n), members[n[:-1]][0] if n else None, len(members[n]), len(children[n]), leaves[n], saved[n], hashlib.sha256(ends(n).encode()).hexdigest()) for n in members
    )


def conversations(seed):
    rng = random.Random(seed)
    lines = ["hi", "hello", "", None, "ça va?", "go on", "x" * 300]
    rows = []
    for c in range(120):
        if rng.random() < 0.15:
            continue  # sources that are absent
        for turn in range(rng.choice([1, 2, 3, 5, 8, 9, 12])):
            rows.append((c, turn, rng.choice(["user", "assistant"]) if turn else "user", rng.choice(lines[: 2 + turn % 5])))
    rows += [(200 + k, t, "user", f"same {t}") for k in range(40) for t in range(11)]  # a hot group of equal ones
    rows += [(300, t, "user", "on") for t in range(1300)] + [(305, t, "user", "on") for t in range(1100)]  # very long ones
    rows += [(7, None, None, "late"), (7, 0, "user", "tie"), (7, 0, "user", "tie"), (7, 0, "a", None), (None, 1, "user", "nobody")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("small", [True, False])
def test_trie_against_a_plain_one(spark, monkeypatch, small):
    from loomgraph.llm import common

    if not small:  # shuffled joins, hot keys dealt out, several pieces of ids and parts of conversations
        monkeypatch.setattr(common, "BROADCAST_ROWS", 3)
        monkeypatch.setattr(prefix_trie, "LISTED", 3)
        monkeypatch.setattr(prefix_trie, "PART", 4)
    rows = conversations(1)
    df = spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn long, role string, text string, depth int").repartition(5)
    for rebuild in (True, False):
        got = prefix_trie.conversation_trie(df, rebuild)
        assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
        assert collections.Counter(map(tuple, got.collect())) == plain_trie(rows, rebuild)


def test_trie_of_few_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert prefix_trie.conversation_trie(spark.createDataFrame([], schema)).count() == 0
    for rows in ([(3, 0, "user", "only")], [(None, None, None, None)], [(k, None, None, None) for k in (5, 6, 6, 11)]):
        got = prefix_trie.conversation_trie(spark.createDataFrame(rows, schema))
        assert collections.Counter(map(tuple, got.collect())) == plain_trie(rows)
