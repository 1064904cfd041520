"""Prefix trie, structure repair and curve packing against plain Python."""

import hashlib
import itertools
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from check import comparable
from tracewell.llm import curve_pack, decontaminate, prefix_trie, repair
from tracewell.llm.common import Store
from tracewell.llm.queries import ORACLES, QUERIES
from tracewell.llm.runs import PRIME, runs

TURNS = "conv_id long, turn long, role string, text string, conv string, at long, depth long, letter string"


@pytest.fixture()
def store(spark):
    return Store(spark, "test")


def test_runs_cross_parts(spark, store):
    rows = [(k, i, bytes([i % 256, k]) * 8 if i % 5 else None) for k, n in ((1, 900), (2, 1), (3, 40), (4, 700), (5, 3)) for i in range(n)]
    frame = spark.createDataFrame(rows, "k long, i long, item binary").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = runs(frame, "k", [F.col("i")], store, "runs", item="item").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    ends, seen = {k: n - 1 for k, n in ((1, 900), (2, 1), (3, 40), (4, 700), (5, 3))}, defaultdict(lambda: [0, 0])
    from tracewell.llm.runs import BASES
    for row in sorted(found, key=lambda r: (r["k"], r["i"])):
        assert row["at"] == row["i"] and row["last"] == (row["i"] == ends[row["k"]])
        lanes = seen[row["k"]]
        assert (row["pa"], row["pb"]) == tuple(lanes)
        if row["i"] % 5:
            content = bytes([row["i"] % 256, row["k"]]) * 8
            for lane, half in enumerate((content[:8], content[8:])):
                lanes[lane] = (lanes[lane] + int.from_bytes(half, "big") * pow(BASES[lane], row["i"], PRIME)) % PRIME
        assert (row["a"], row["b"]) == tuple(lanes)
    assert len(found) == len(rows)


def plain_trie(conversations):
    """Every node of whole conversations {id: [(role, text)]} by its definition."""
    nodes = defaultdict(list)
    for conv in sorted(conversations):
        for depth in range(len(conversations[conv]) + 1):
            nodes[tuple(conversations[conv][:depth])].append(conv)
    rows = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[:len(path)] == path]
        ends = ",".join(str(c) for c in members if len(conversations[c]) == len(path))
        childless = [p for p in below if not any(len(q) == len(p) + 1 and q[:len(p)] == p for q in nodes)]
        rows.append((members[0], len(path), nodes[path[:-1]][0] if path else None, len(members), sum(len(p) == len(path) + 1 for p in below), len(childless),
                     sum((len(nodes[p]) - 1) * len(p[-1][1].encode()) for p in below if p), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows)


@pytest.mark.parametrize("cells", [1 << 24, 16])
def test_trie_against_definition(spark, store, cells):
    draw = random.Random(cells)
    conversations = {}
    for conv in range(-40, 160):
        shared = conversations[draw.choice(list(conversations))] if conversations and draw.random() < 0.7 else []
        start = shared[:draw.randint(0, len(shared))]
        conversations[conv] = [*start, *[(draw.choice("ua"), "t" * draw.randint(0, 3)) for _ in range(draw.choice([0, 1, 2, 9]))]] or [("u", "é")]
    for copy in range(200, 260):
        conversations[copy] = [("u", "common")] * 30
    rows = [(conv, turn, role, text) for conv, turns in conversations.items() for turn, (role, text) in enumerate(turns)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    found = prefix_trie.prefix_trie(prefix_trie.opened(store.save(prefix_trie.turns(frame, store), "own")), store, cells)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, found.select(columns).collect())) == plain_trie(conversations)


def shortest(letters):
    """The cheapest edits, row by row over all states."""
    def inserted(at):
        for _ in range(4):
            for state, (cost, audit) in list(at.items()):
                role, way = repair._wanted(state), (cost + 2, audit + "I")
                at[role] = min(at.get(role, way), way)
        return at

    at = {repair.START: (0, "")}
    for letter in letters:
        (fault, initial), ways = divmod(repair.LETTERS.index(letter), 4), defaultdict(list)
        for state, (cost, audit) in inserted(at).items():
            ways[state].append((cost + 3, audit + "D"))
            if fault not in (1, 2):
                role = (initial + 1) % 4
                if role and repair._fits(state, role):
                    ways[role].append((cost + (fault == 3), audit + "K"))
                ways[repair._wanted(state)].append((cost + 2 + (fault == 3), audit + "R"))
        at = {state: min(found) for state, found in ways.items()}
    at = inserted(at)
    return min(at[state] for state in (repair.START, repair.ASSISTANT) if state in at)


def test_search_in_blocks_of_any_size():
    draw = random.Random(4)
    for number in range(700):
        letters = "".join(draw.choice(repair.LETTERS if draw.random() < 0.3 else "ABC") for _ in range(number % 26 + 1))
        size = draw.choice([1, 2, 3, 5, 64])
        blocks = [letters[at:at + size] for at in range(0, len(letters), size)]
        assert repair._joined([repair._block(block, at == 0, at == len(blocks) - 1) for at, block in enumerate(blocks)]) == shortest(letters)


def awkward_turns():
    draw = random.Random(9)
    roles, texts = ["user", "assistant", "system", None, "", "tool", "ü"], ["Yes.", "No", None, "", " \t", "a.\n", "why? ", "dup!", "dup!", "é…"]
    rows = [(conv, draw.choice([None, *range(-2, 12)]), draw.choice(roles[:2] if draw.random() < 0.7 else roles), draw.choice(texts))
            for conv in [None, *range(-6, 60)] for _ in range(draw.choice([1, 3, 8]))]
    rows += [(100, turn, ("user", "assistant")[turn % 2], f"turn {turn}.") for turn in range(300)] + [(105, turn, "user", "same.") for turn in range(200)]
    rows += [(5, 1, "user", "word " * 100_000), (110, 2, "user", "twice."), (110, 2, "user", "twice.")]
    return [(*row, "x", 1, 2, "y") for row in rows]


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_conversation_repair"])
def test_awkward_turns(spark, tmp_path, name):
    spark.createDataFrame(awkward_turns(), TURNS).repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    found = QUERIES[name](spark, str(tmp_path))
    columns = sorted(found.columns)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    expected = duck.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]}) o").fetchall()
    rows = sorted(comparable(row) for row in found.select(columns).collect())
    assert rows == sorted(comparable(row) for row in expected) and len(rows) > 60


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_conversation_repair", "op13_curve_packing"])
def test_empty_tables(spark, tmp_path, name):
    spark.createDataFrame([], TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert QUERIES[name](spark, str(tmp_path)).collect() == []


def test_repaired_turns_read_back(spark, store):
    rows = [(1, 0, "user", "a."), (1, 1, "user", "b."), (1, 2, "assistant", "c"), (2, 0, "assistant", "x."), (3, 0, "system", "s."), (3, 1, "user", " ")]
    named = repair.named(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    audits = repair.repairs(repair.faulty(named, store)).select("conv", "audit")
    found = defaultdict(list)
    for row in repair.repaired_turns(named, audits).orderBy("conv", "at").collect():
        found[row["conv"]].append((row["role"], row["text"]))
    assert found == {"1": [("user", "a."), ("assistant", ""), ("user", "b."), ("assistant", "c")], "2": [("user", ""), ("assistant", "x.")]}


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3)])
def test_hilbert_neighbours_share_a_face(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    keys = curve_pack.hilbert_key(cells, bits)
    order = np.argsort(keys)
    assert (keys[order] == np.arange(len(keys))).all() and (np.abs(np.diff(cells[order], axis=0)).sum(axis=1) == 1).all()


def packed_rightly(pieces, documents, length):
    """Every id in one piece, sequences without gaps, whole or of a power of two."""
    import public_tokenizers
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    wanted = sorted((number, [*exact.encode(text or "", add_special_tokens=False).ids, 1]) for number, text in documents)
    by_doc, by_sequence = defaultdict(list), defaultdict(int)
    for row in sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"])):
        assert row["offset"] == by_sequence[row["sequence_id"]]
        ids = np.frombuffer(row["ids"], "<u4").tolist()
        by_sequence[row["sequence_id"]] += len(ids)
        by_doc[row["doc_id"]].append((row["start"], ids))
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    assert all(size == length or size & (size - 1) == 0 for size in by_sequence.values())
    for number in by_doc:
        whole = sum((ids for _, ids in sorted(by_doc[number])), [])
        assert [whole] == [ids for other, ids in wanted if other == number]
    assert len(by_doc) == len(wanted)


@pytest.mark.parametrize("length", [2048, 7])
def test_packing_against_plain_tokenizer(spark, store, length):
    draw = random.Random(length)
    words = ["stone", "river", "größe", "don't", "été", "12345", "日本", "\n", "  ", "<|endoftext|>", "🙂"]
    documents = [(number, " ".join(draw.choice(words) for _ in range(draw.choice([0, 3, 80])))) for number in range(60)]
    documents += [(100, None), (101, ""), (102, " " * 310_000 + "x"), (103, documents[5][1])]
    frame = spark.createDataFrame([(*row, 1, "x") for row in documents], "doc_id long, text string, row long, ids string").repartition(4)
    pieces = curve_pack.pack(frame, store, length).collect()
    packed_rightly(pieces, documents, length)
    joined = curve_pack.sequences(spark.createDataFrame([(r["sequence_id"], r["offset"], r["ids"]) for r in pieces], "sequence_id long, offset long, ids binary"))
    sizes = {row["sequence_id"]: len(row["ids"]) // 4 for row in joined.collect()}
    assert sum(sizes.values()) == sum(len(r["ids"]) // 4 for r in pieces) and max(sizes.values()) <= length


def test_packing_keeps_kinds_together(spark, store):
    draw = random.Random(1)
    kinds = [["stone", "river", "light", "house", "green"], ["größe", "ähnlich", "straße", "über", "schön"], ["qu'il", "été", "où", "déjà", "çà"]]
    documents = [(number, " ".join(draw.choice(kinds[number % 3]) for _ in range(60))) for number in range(300)]
    pieces = curve_pack.pack(spark.createDataFrame(documents, "doc_id long, text string").repartition(4), store).collect()
    line = [row["doc_id"] % 3 for row in sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"]))]
    assert sum(a != b for a, b in zip(line, line[1:])) < len(line) / 10


def test_packing_query(spark, data):
    rows = QUERIES["op13_curve_packing"](spark, data).collect()
    documents = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    import public_tokenizers
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {row["doc_id"]: [*exact.encode(row["text"] or "", add_special_tokens=False).ids, 1] for row in documents}
    assert sum(row["length"] for row in rows) == sum(map(len, ids.values()))
    for row in rows:
        piece = ids[row["doc_id"]][row["start"]:row["start"] + row["length"]]
        assert len(piece) == row["length"] and row["doc_tokens"] == len(ids[row["doc_id"]])
        assert zlib.crc32(np.array(piece, "<u4").tobytes()) == row["ids_crc32"]


def test_pipeline_run(spark, data):
    """The whole pipeline on the smallest tables: what each stage promises holds for what comes out."""
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, data).collect()
    ids = {row["doc_id"] for row in rows}
    by = lambda name: {row["doc_id"]: row for row in QUERIES[name](spark, data).collect()}
    rules, leaks = by("op3_quality_rules"), by("op2_benchmark_decontamination")
    texts = {row["doc_id"]: row["text"] for row in spark.read.parquet(f"{data}/documents.parquet").collect()}
    assert ids and ids <= {d for d, row in rules.items() if row["kept"]} and not any(leaks[d]["contaminated"] for d in ids)
    assert len({texts[d] for d in ids}) == len(ids)  # one of each group of equal texts

    def shingles(text):
        words = "".join(c.lower() if c.isascii() else c for c in text).split()
        return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}

    sets = {d: shingles(texts[d]) for d in sorted(ids)}
    for (a, left), (b, right) in itertools.combinations(sets.items(), 2):
        assert 100 * len(left & right) < 75 * len(left | right), (a, b)
    sizes, slots = defaultdict(int), defaultdict(list)
    for row in rows:
        assert row["law"] == "rows" and row["text_crc32"] == zlib.crc32(texts[row["doc_id"]].encode()) and row["size"] == len(texts[row["doc_id"]].encode()) + 1
        sizes[row["doc_id"]] += 1
        slots[row["shard"]].append(row["slot"])
    assert max(sizes.values()) <= 2 and max(map(len, slots.values())) - min(len(slots.get(k, [])) for k in range(16)) <= 1
    assert all(sorted(found) == list(range(len(found))) for found in slots.values())


def test_many_benchmark_blocks_keep_the_plan_small(spark, store):
    """Fifty blocks mark what one block marks, with one Python stage in the last plan."""
    draw = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(draw.choice(words) for _ in range(draw.choice([3, 9, 12])))) for i in range(60)]
    docs = [(i, " ".join([*(draw.choice(words) for _ in range(20)), items[i % 60][1] if i % 2 else "none", *(draw.choice(words) for _ in range(5))])) for i in range(80)]
    asked, held = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    whole = decontaminate.contamination(asked, held, store)
    blocks = decontaminate.contamination(asked, held, Store(spark, "blocks"), block_words=9)
    found = lambda frame: sorted((r.doc_id, r.found.n_words, r.found.n_hit, tuple(r.found["items"])) for r in frame.collect())
    assert found(whole) == found(blocks) and sum(row[2] > 0 for row in found(whole)) >= 40
    assert blocks._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
