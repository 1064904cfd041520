"""Operators against plain Python on small fixtures: brute force, round trips, held-out accuracy, odd rows."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tracewell.llm import arc, decontaminate, html_blocks, mixing, neardup, rules, secret_scan, sharding, suffix_lm, zstd_quality
from tracewell.llm.common import Store, numbered
from tracewell.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def words(draw, count):
    return " ".join(draw.choice(["the", "of", "and", "stone", "river", "light", "house", "paper", "green", "walk"]) + draw.choice(["", "s", "ed"])
                    for _ in range(count))


def odd_rows():
    draw = random.Random(3)
    text = words(draw, 80)
    return [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (None, text, None, None, None), (None, None, None, None, None), (2, "", "en", "a", 0),
            (3, " \n ", "en", "b", 0), (4, text + " end", "en", "b", 0), (5, words(draw, 20_000), "en", "a", 0), (6, "x", "en", "c", 0),
            (7, words(draw, 200), "en", "c", 0), (7, words(draw, 200), "en", "c", 0)]


@pytest.fixture()
def store(spark):
    return Store(spark, "test")


def test_numbered(spark, store):
    frame = spark.createDataFrame([(i % 7, i, i % 5) for i in range(1000)], "k int, i long, size long").repartition(5)
    rows = numbered(frame, [F.col("k"), F.col("i")], store, "rows", size="size").collect()
    expected, before = sorted((i % 7, i, i % 5) for i in range(1000)), 0
    for number, (row, wanted) in enumerate(zip(sorted(rows, key=lambda r: r["number"]), expected)):
        assert (row["k"], row["i"], row["size"], row["number"], row["before"]) == (*wanted, number, before)
        before += wanted[2]


def test_arc_parser_versions_and_errors():
    payload = b"<p>\r\n\r\n\n x</p>"
    content = arc._arc_opening(1) + b"\n" + arc._arc_record(1, 4, b"http://a b/", payload) + b"\n" + arc._arc_opening(2) + b"\n" + arc._arc_record(2, None, None, b"")
    first, second = arc._arc_records(content)
    assert first["version"] == 1 and first["fields"]["URL"] == b"http://a%20b/" and arc._split_http(first["block"])[1] == payload
    assert second["version"] == 2 and second["fields"]["Result-code"] == b"200"
    with pytest.raises(ValueError):
        list(arc._arc_records(content[:len(content) - 5]))
    with pytest.raises(ValueError):
        list(arc._arc_records(arc._arc_record(1, 1, b"u", b"x") + b"\n"))
    assert arc._iso_date("1997") == "1997-01-01T00:00:00Z"


def test_suffix_automaton_against_brute_force():
    draw = random.Random(1)
    for _ in range(60):
        items = [(str(i), [draw.choice([b"a", b"b", b"c"]) for _ in range(draw.randint(0, 9))]) for i in range(5)]
        text = [draw.choice([b"a", b"b", b"c", b"d"]) for _ in range(60)]
        automaton, mask, names = decontaminate.SuffixAutomaton(items, 4), np.zeros(60, bool), set()
        automaton.scan(text, mask, names)
        wanted, owners = np.zeros(60, bool), set()
        for name, item in items:
            size = min(4, len(item))
            for k in range(len(item) - size + 1 if item else 0):
                for at in range(60 - size + 1):
                    if text[at:at + size] == item[k:k + size]:
                        wanted[at:at + size] = True
                        owners.add(name)
        assert (mask == wanted).all() and names == owners


def test_decontaminate_blocks_cuts_and_drops(spark, store):
    passage = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, f"Before, it. {passage.upper()}! After it.", "m"), (2, passage, "n"), (3, "clean text", "o")], "doc_id long, text string, found string")
    items = spark.createDataFrame([(1, passage), (2, "unrelated words " * 9)], "item_id long, text string")
    kept = {r.doc_id: r for r in decontaminate.decontaminate(docs, items, store, max_coverage=0.8).collect()}
    assert set(kept) == {1, 3} and kept[1].text == "Before, it. After it." and kept[3].text == "clean text" and kept[1].found == "m"
    one = decontaminate.contamination(docs, items, store).select("doc_id", "found.n_hit", "found.items").collect()
    many = decontaminate.contamination(docs, items, store, block_words=12).select("doc_id", "found.n_hit", "found.items").collect()
    assert sorted(map(str, one)) == sorted(map(str, many)) and sum(r.n_hit for r in one) == 22


def brute_counts(text):
    text = text or ""
    found = re.findall(r"[^\x20\x09-\x0d]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0d]", line)]
    windows = [tuple(found[i:i + 3]) for i in range(len(found) - 2)]
    counts = Counter(windows)
    inside = {i + k for i, window in enumerate(windows) if counts[window] > 1 for k in range(3)}
    return (len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside))


def test_rule_counts_and_learning(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet").limit(100).collect()
    texts = [r.text for r in rows] + [r[1] for r in odd_rows()] + ["a b c a b c a b c", "x\nx\n\n \nx y\x0b"]
    for text in texts:
        assert rules.text_counts(text.encode() if text else None)[:5] == brute_counts(text)
    found = rules.learn_rules(spark.read.parquet(f"{data.replace('0.001', '0.01')}/documents.parquet"), spark.read.parquet(f"{data.replace('0.001', '0.01')}/labels.parquet"))
    assert found and all(condition.name in rules.RATIOS for rule in found for condition in rule)
    assert rules.learn_rules(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)) == []


def test_secrets_against_brute_force(spark, store):
    draw = random.Random(5)
    alphabet = secret_scan.ALPHABETS["base64"]
    random_tokens = ["".join(draw.choice(alphabet) for _ in range(40)) for _ in range(40)]
    plain = ["".join(draw.choice(["tion", "heit", "erber", "ing", "ou"]) for _ in range(8)) for _ in range(60)]
    texts = ["password=token=abcdefgh", "password: token : abcdefgh", 'API_KEY = "x1y2z3w4"', "AKIA" + "A1" * 8, "AKIAB", "é" * 3 + "0af" * 9, "secret:short", "ſecret=abcdefgh",
             None, "", "0123456789abcdef" * 3 + " tail"] + [f"é {t} x" for t in random_tokens + plain]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    keyword = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in k) for k in ("password", "passwd", "secret", "token")) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
    assign = re.compile(rf"({keyword})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    for row in secret_scan.scan(frame, store).collect():
        text = texts[row.doc_id] or ""
        wanted = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
        wanted += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        wanted += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        assert [tuple(s) for s in row.base] == sorted(wanted), text
    hit = {r.doc_id for r in secret_scan.scan(frame, store).collect() if r.random}
    assert len(hit & set(range(11, 51))) >= 36 and not hit & set(range(51, 111))


def test_secrets_beside_names_and_base_spans(spark, store):
    draw = random.Random(6)
    whole = lambda size: "".join(draw.choice(secret_scan.ALPHABETS["base64"][:62]) for _ in range(size))
    forms = ["credential={}", "x é ?sig={}&b=1", "a={}==", "{}_password=abcdefgh", "{}/api_key=abcdefgh secret=abcdefghi", "AKIA" + "A1" * 9 + "-{}",
             "bearer=={}=x", "é passwd=abcdefgh {}"]
    texts = [(form, token) for form in forms for token in (whole(40) for _ in range(25))]
    frame = spark.createDataFrame([(i, form.format(token)) for i, (form, token) in enumerate(texts)], "doc_id long, text string")
    hits = Counter()
    for row in secret_scan.scan(frame, store).collect():
        (form, token), text = texts[row.doc_id], texts[row.doc_id][0].format(texts[row.doc_id][1])
        for start, kind, end in row.random:
            assert kind == 3 and token in text[start:end] and len(text[start:end].strip("_/-=")) == 40
            assert not any(s < end and start < e for s, _, e in row.base)
            hits[form] += 1
    assert all(hits[form] >= 20 for form in forms), hits


def test_secrets_in_a_text_of_many_spans(spark, store):
    """Overlapping spans of all kinds, as many as a dump has, against plain Python; running numbers are no secrets."""
    draw = random.Random(12)
    some = ["token=" + "ab12" * 8, "0123456789abcdef" * 2, "AKIA" + "B7" * 9, "plain words", "é", "secret: abc", "passwd=AKIA" + "C" * 18]
    text = " ".join(draw.choice(some) for _ in range(9000))
    numbers = "1234567890123456789012 2345678901234567890123456 number 10000000000000000000001"
    base, marked = {}, {}
    frame = spark.createDataFrame([(1, text), (2, numbers), (3, text[:200])], "doc_id long, text string")
    for row in frame.select("doc_id", secret_scan.base_spans(F.col("text")).alias("base"), secret_scan.uncovered(
            F.col("text"), secret_scan.base_spans(F.col("text"))).alias("open")).collect():
        base[row.doc_id], marked[row.doc_id] = row.base, row.open
    wanted = [(m.start(), 0, m.end()) for m in re.finditer(r"(?:token|secret|passwd)[:=]\x20*([A-Za-z0-9+/_.=-]+)", text) if len(m[1]) >= 6]
    wanted += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    wanted += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    assert [tuple(s) for s in base[1]] == sorted(wanted)
    blanked = list(text)
    for start, _, end in wanted:
        blanked[start:end] = " " * (end - start)
    assert marked[1] == "".join(blanked)
    assert not [r for r in secret_scan.scan(frame.filter("doc_id = 2"), store).collect() if r.random]


def test_secret_cuts_follow_the_false_share(spark, store):
    """Short tokens of skewed letters, a part of which passes the least p: the band's cut rises until few of them are called."""
    draw = random.Random(8)
    alphabet = secret_scan.ALPHABETS["base64"]
    skewed = alphabet + "abcdefghijklmnopqrstuvwxyz" * 2
    rows = [("".join(draw.choice(alphabet) for _ in range(60)), True) for _ in range(300)]
    rows += [("".join(draw.choice(skewed) for _ in range(24)), False) for _ in range(2000)]
    frame = spark.createDataFrame([(i, token) for i, (token, _) in enumerate(rows)], "doc_id long, text string")
    found = store.save(frame.withColumn("candidates", secret_scan.candidates(F.col("text"))), "made")
    passed = Counter(c.stratum for r in found.collect() for c in r.candidates if c.p > secret_scan.LEAST_P)
    hits = Counter(c.kind and rows[r.doc_id][1] for r in secret_scan.scan(frame, store).collect() for c in r.random)
    assert passed[8] > 400 and hits[False] < passed[8] * 0.8  # the skewed band
    assert hits[True] >= 0.9 * 300 and hits[True] >= 0.99 * passed[10]  # the random band keeps the least cut
    made = [800 + 45 * b for b in range(secret_scan.P_BINS + 1)]
    assert secret_scan._cut([n * 50 for n in made], made) == len(made)
    assert 0 < secret_scan._cut([n * 50 + max(0, b - 9) * 4000 for b, n in enumerate(made)], made) <= 11
    assert secret_scan._cut([0] * 20 + [100_000] * 7, made) <= 20


def test_near_duplicates_against_brute_force(spark, store):
    draw = random.Random(9)
    texts = []
    for _ in range(12):
        base = words(draw, 60).split()
        for _ in range(draw.randint(1, 12)):
            copy = list(base)
            for _ in range(draw.randint(0, 4)):
                copy[draw.randrange(len(copy))] = draw.choice(["new", "other", "word"]) + str(draw.randrange(99))
            texts.append(" ".join(copy))
    texts += [None, "", "  ", "two words", "Two Words", texts[0].upper()]
    docs = spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {r.doc_id: r for r in neardup.near_duplicates(docs, store).collect()}
    sets = []
    for text in texts:
        w = (text or "").lower().split()
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    for i in range(len(texts)):
        assert (found[100 + i].component_id, found[100 + i].n_shingles) == (100 + root(i), len(sets[i]))
    kept = [r.doc_id for r in neardup.keep_first(docs, store).collect()]
    assert sorted(kept) == [100 + i for i in range(len(texts)) if root(i) == i]


def test_block_links_match_pairwise():
    import pyarrow as pa

    draw = np.random.default_rng(2)
    sets = [np.unique(draw.integers(0, 40, draw.integers(1, 30))) for _ in range(30)]
    table = pa.table({"cid": pa.array(range(30), pa.int64()), "comp": pa.array([i % 20 for i in range(30)], pa.int64()), "shingles": pa.array([s.tolist() for s in sets], pa.list_(pa.int64()))})
    found = set(zip(*[v.tolist() for v in neardup._block_links(table, table)]))
    wanted = {(i, j) for i in range(30) for j in range(30) if i % 20 != j % 20 and 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))}
    assert found == wanted


def test_quality_on_held_out_labels(spark, data):
    folder = data.replace("0.001", "0.01")
    rows = {r.doc_id: r for r in zstd_quality.op6(spark, folder).collect()}
    labels = [(rows[r.doc_id], r.quality) for r in spark.read.parquet(f"{folder}/labels.parquet").collect()]
    held = [(r, q) for r, q in labels if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows.values())
    assert np.mean([r.predicted == q for r, q in held]) > 0.9
    assert zstd_quality.learn(spark.createDataFrame([], DOCS), spark.createDataFrame([(1, 1, 0)], LABELS)) == 0.5


def test_dictionary_blocks_come_from_all_texts(spark, monkeypatch):
    samples = []
    monkeypatch.setattr(zstd_quality, "DICTIONARY_BLOCKS", 40)
    monkeypatch.setattr(zstd_quality, "_dictionary", lambda blocks: samples.append(blocks) or b"".join(blocks))
    docs = [(i, f"<{i:05d}>" * 2400, "en", "a", 0) for i in range(100)]
    zstd_quality.learn(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(i, i % 2, 0) for i in range(100)], LABELS))
    ids = [{re.search(rb"<(\d+)>", block)[1] for block in blocks} for blocks in samples]
    assert len(samples) == 2 and all(len(blocks) == 40 and len(found) >= 12 for blocks, found in zip(samples, ids))


def test_main_text_of_pages(spark, data):
    import html as escapes

    pages = spark.read.parquet(f"{data}/pages.parquet").collect()
    found = {r.page_id: r for r in html_blocks.op7(spark, data).collect()}
    right = 0
    for page in pages:
        article = re.search(r"<article>(.*?)</article>", page.html, re.S)[1]
        blocks = [" ".join(escapes.unescape(re.sub(r"<[^>]*>", " ", part)).split()) for part in re.split(r"</?(?:p|h1)\b[^>]*>", article)]
        right += found[page.page_id].text == "\n".join(b for b in blocks if b)
        assert found[page.page_id].n_chars == len(found[page.page_id].text)
    assert right >= 0.97 * len(pages)
    for odd in (None, "", "<", "<p", "<script>x", "<!-- <p>x</p>", "</p></div>", "<p>" * 300):
        assert isinstance(html_blocks.main_texts([odd], None, html_blocks.Vectors())[0], str)


def test_raw_elements_hide_only_themselves():
    def texts(page):
        return [text for _, text, _ in html_blocks.page_blocks(page)]

    for name in html_blocks.RAW:
        assert texts(f"<p>one <{name}-x a=b></{name}-x></p><p>two</p>") == ["one", "two"], name
        assert texts(f"<p>one <{name} a='>'>hidden <p></{name} > end</p><p>two</p>") == ["one end", "two"], name
        left = texts(f"<p>one</p><{name}><p>two</p><{name.upper()}>three")
        assert left == (["one", "two", "three"] if name in ("svg", "object") else ["one"]), name
    assert texts('<p>one <svg aria-label="a>b" /> end</p><p>two <svg/>too</p>') == ["one end", "two too"]
    assert texts("<p>one</p><script/>two</script><p>three</p>") == ["one", "three"]


def test_lstm_gradients():
    net = html_blocks.Network(3)
    net.p = {name: value.astype(np.float64) for name, value in net.p.items()}
    draw = np.random.default_rng(0)
    x, lengths, wanted = draw.normal(size=(2, 4, html_blocks.DIMS)).astype(np.float32), np.array([4, 2]), np.array([[1, 0, 1, 1], [0, 1, 0, 0]], np.float32)

    def loss():
        p = net.forward(x, lengths)
        mask = np.arange(4) < lengths[:, None]
        return -float((np.where(wanted > 0, np.log(p), np.log(1 - p)) * mask).sum() / mask.sum())

    grads = net.gradients(x, lengths, wanted)
    for name, at in (("wo", (1,)), ("wxf", (3, 5)), ("whb", (2, 7)), ("bf", (9,)), ("wxb", (8, 33))):
        step = 1e-2
        net.p[name][at] += step
        up = loss()
        net.p[name][at] -= 2 * step
        down = loss()
        net.p[name][at] += step
        assert abs((up - down) / (2 * step) - grads[name][at]) < 2e-3


def test_suffix_tree_base_scores_and_sum_to_one(spark, data, store):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    counts = Counter(t for i, text in docs.items() if zlib.crc32(str(i).encode()) % 7 != 2 for t in suffix_lm.tokens(text.encode()))
    total, scale = sum(counts.values()), math.log10(sum(counts.values()) + len(counts) + 1)
    better = 0
    for row in suffix_lm.op8(spark, data).collect():
        found = suffix_lm.tokens(docs[row.doc_id].encode())
        base = sum(math.log10(counts[t] + 1) - scale for t in found)
        assert (row.train_tokens, row.n_tokens, row.n_known) == (total, len(found), sum(counts[t] > 0 for t in found))
        assert math.isclose(base, row.base_score, rel_tol=1e-9)
        better += row.score > row.base_score
    assert better > 0.8 * len(docs)
    model = suffix_lm.train(spark.read.parquet(f"{data}/documents.parquet"), store)
    head, size = model.counts, len(model.counts)
    root, all_ = (head + 1) / (model.total + model.distinct + 1), np.arange(size)
    for context in model.tree.levels[0]["codes"][:3].tolist():
        flat = np.stack([np.full(size, context), all_], axis=1).reshape(-1)
        ratio = model.tree.ratio(flat, np.full(size, 2), np.repeat(root, 2))[1::2]
        weight = model.tree.levels[0]["keep"][model.tree.levels[0]["codes"].tolist().index(context)]
        assert math.isclose(float((ratio * root).sum()) + weight * (1 - root.sum()), 1.0, rel_tol=1e-6)


def _tree_scores(texts, trained, depth=4):
    """Scores over the root's from plain dictionaries: every context of up to ``depth`` words, every next word seen twice."""
    rows = [suffix_lm.tokens(text.encode()) for text in texts]
    learned = [row for row, is_trained in zip(rows, trained) if is_trained]
    times = [None] + [Counter(tuple(row[i:i + n]) for row in learned for i in range(len(row) - n + 1)) for n in range(1, depth + 2)]
    size = sum(times[1].values()) + len(times[1]) + 1
    listed, keep, parent = {}, {}, {gram: (n + 1) / size for gram, n in times[1].items()}
    for length in range(1, depth + 1):
        entries, now = {}, {}
        for gram, n in times[length + 1].items():
            if n >= 2 and gram[1:] in parent and (length == 1 or gram[1:-1] in keep):
                entries.setdefault(gram[:-1], []).append((gram, n))
        for context, found in entries.items():
            held = times[length][context]
            rest = max(1 - sum(n for _, n in found) / held, 0)
            gain = sum(n * math.log(n / held / parent[gram[1:]]) for gram, n in found)
            gain += held * rest * math.log(rest / (1 - min(sum(parent[gram[1:]] for gram, _ in found), 1 - 1e-12))) if rest > 0 else 0
            if 2 * gain > len(found) + suffix_lm.DIVERGENCE * math.sqrt(2 * len(found)):
                keep[context] = max(1 - sum(n - suffix_lm.DISCOUNT for _, n in found) / held, 1e-9)
                now.update({gram: (n - suffix_lm.DISCOUNT) / held + keep[context] * parent[gram[1:]] for gram, n in found})
        listed.update(now)
        parent = now
    scores = []
    for row in rows:
        total = 0.0
        for i, word in enumerate(row):
            p = (times[1][(word,)] + 1) / size
            for length in range(1, min(depth, i) + 1):
                context = tuple(row[i - length:i])
                if context not in keep:
                    break
                p = listed.get((*context, word), keep[context] * p)
            total += math.log10(p)
        scores.append(total)
    return scores, keep


@pytest.mark.parametrize("share", [None, 0.01])
def test_suffix_tree_against_plain_dictionaries(spark, store, monkeypatch, share):
    """Rare contexts, rare next words and long contexts count, whether tasks know them or they are joined."""
    if share:
        monkeypatch.setattr(suffix_lm, "WORD_SHARE", share)
        monkeypatch.setattr(suffix_lm, "CONTEXT_SHARE", share)
    draw = random.Random(8)
    vocabulary = [f"w{i}" for i in range(60)] + [f"rare{i}" for i in range(300)]
    phrases = [[draw.choice(vocabulary) for _ in range(7)] for _ in range(6)]
    rows = []
    for i in range(300):
        text = draw.choices(vocabulary, weights=[1 / (j + 1) for j in range(360)], k=draw.randint(0, 40)) + draw.choice(phrases) + draw.choices(vocabulary[:9], k=3)
        rows.append((i, " ".join(text), "en", "a", 0))
    for i in range(300, 500):
        bits = [1, 0, 1, 1]
        for _ in range(100):  # the next word depends on four before it
            bits.append(int(draw.random() < 0.05 + 0.06 * sum(b * w for b, w in zip(bits[-4:], (3, 3, 4, 5)))))
        rows.append((i, " ".join(f"b{bit}" for bit in bits), "en", "a", 0))
    docs = spark.createDataFrame(rows, DOCS)
    trained = [row[0] % 5 > 0 for row in rows]
    model = suffix_lm.train(docs.filter("doc_id % 5 > 0"), store)
    expected, keep = _tree_scores([row[1] for row in rows], trained)
    assert any(len(context) == 4 for context in keep)
    found = {r.doc_id: r.score for r in suffix_lm.score(docs, model, store).collect()}
    assert all(math.isclose(found[row[0]], score, rel_tol=1e-9) for row, score in zip(rows, expected))


def test_suffix_tree_keeps_contexts_of_any_share(spark, store):
    """In 700,000 tokens, a phrase seen 60 times with always the same next word."""
    draw = random.Random(3)
    rows = [(i, " ".join(f"n{draw.randrange(3000)}" for _ in range(1000)) + (" alpha beta gamma delta" if i < 60 else ""), "en", "a", 0) for i in range(700)]
    docs = spark.createDataFrame([*rows, (1000, "alpha beta gamma delta", "en", "a", 0)], DOCS)
    model = suffix_lm.train(docs.filter("doc_id < 1000"), store)
    row = suffix_lm.score(docs.filter("doc_id = 1000"), model, store).first()
    assert row.score > row.base_score + 5


def test_suffix_tree_in_many_blocks(spark, store, monkeypatch):
    """Contexts of one to four words too frequent for a block, blocks dealt in rounds, words known to few tasks."""
    monkeypatch.setattr(suffix_lm, "BLOCK", 300)
    monkeypatch.setattr(suffix_lm, "WORD_SHARE", 0.005)
    draw = random.Random(9)
    rows = []
    for i in range(240):
        text = draw.choices([f"w{j}" for j in range(200)], weights=[1 / (j + 1) for j in range(200)], k=draw.randint(0, 30))
        text[5:5] = ["a", "b", "a", "a", "b", "a", f"w{i % 3}"] * draw.randint(0, 3)
        rows.append((i, " ".join(text) if i % 50 else None, "en", "a", 0))
    rows += [(300 + i, "the same text for many rows of it", "en", "a", 0) for i in range(250)]
    docs = spark.createDataFrame(rows, DOCS)
    expected, keep = _tree_scores([(row[1] or "") for row in rows], [row[0] % 5 > 0 for row in rows])
    model = suffix_lm.train(docs.filter("doc_id % 5 > 0"), store)
    local = store.save(suffix_lm.local_docs(docs.selectExpr("doc_id", "text", "doc_id % 5 > 0 as train", "true as scored"), model), "local")
    plan, _ = suffix_lm.hot_contexts(local.filter("train").select("n_tokens", "codes"), model, 20, store)
    assert len(plan.levels) == 4 and any((level["keep"] > 0).any() for level in plan.levels[1:])
    for trained in (None, F.col("doc_id") % 5 > 0):  # the model's texts apart, and among those to score
        found = {r.doc_id: r.score for r in suffix_lm.score(docs, model, store, trained).collect()}
        assert len(found) == len(rows) and all(math.isclose(found[row[0]], score, rel_tol=1e-9, abs_tol=1e-9) for row, score in zip(rows, expected))


def test_suffix_tree_stores_little(spark, store, tmp_path):
    """What a run stores, with 400,000 tokens of 14 bits each."""
    draw = random.Random(4)
    words = [f"n{i}" for i in range(40_000)]
    docs = spark.createDataFrame([(i, " ".join(draw.choices(words, cum_weights=range(1, 40_001), k=400)), "en", "a", 0) for i in range(1000)], DOCS)
    store.folder = str(tmp_path / "steps")
    suffix_lm.score(docs, suffix_lm.train(docs, store), store).count()
    assert sum(f.stat().st_size for f in tmp_path.rglob("*.parquet")) < 10 * 400_000


def test_mix_targets_and_stage(spark, store):
    draw = random.Random(4)
    rows = [(i, words(draw, draw.randint(1, 40)), "en", draw.choice(["a", "a", "a", "b", "c", None]), 0) for i in range(600)]
    docs = spark.createDataFrame(rows, DOCS)
    found = mixing.mix(docs, store).collect()
    for source in ("a", "b", "c", None):
        part = [r for r in found if r.source == source]
        assert abs(sum(r.taken for r in part) - part[0].target) <= 40 and all(r.taken <= 2 * r.size for r in part)
    assert math.isclose(sum({r.source: r.target for r in found}.values()), 1.5 * sum(r.size for r in found))
    mixed = Counter(r.doc_id for r in mixing.mixed_documents(docs, store).collect())
    assert mixed == Counter({r.doc_id: r.taken // r.size for r in found if r.taken})


def test_shards_even_and_groups_whole(spark, store):
    rows = [(i, f"text {i % 150}" if i < 400 else f"own {i}") for i in range(1000)] + [(2000 + i, "hot") for i in range(500)] + [(5000, None), (None, None)]
    found = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string"), store).collect()
    sizes = Counter(r.shard for r in found)
    assert len(found) == len(rows) and set(sizes) == set(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
    for shard, size in sizes.items():
        assert sorted(r.slot for r in found if r.shard == shard) == list(range(size))
    texts = dict(rows)
    places = {}
    for r in found:
        if texts[r.doc_id] is not None:
            places.setdefault(texts[r.doc_id], set()).add(r.shard)
            assert r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
    assert sum(len(s) > 1 for t, s in places.items() if t != "hot") <= 8 and len(places["hot"]) <= 10


@pytest.mark.parametrize("rows", [[], odd_rows()], ids=["empty", "odd"])
def test_stages_and_queries_take_any_rows(spark, tmp_path, rows):
    folder = str(tmp_path)
    extra = [(*row, "x", 1, "y") for row in rows]
    spark.createDataFrame(extra, DOCS + ", stats string, found long, shard string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 0, 0), (1, 1, None), (7, 1, 0), (None, 1, 0), (99, 0, 1)] if rows else [], LABELS).write.parquet(f"{folder}/labels.parquet")
    items = [(1, "stone river light", "x", 1, 2), (None, None, "x", 1, 2)] if rows else []
    spark.createDataFrame(items, "item_id long, text string, name string, words long, number long").write.parquet(f"{folder}/benchmark.parquet")
    long = "<article><p>" + "Long text is here. " * 20_000 + "</p></article>"
    pages = [(page, url, html, "x", 1, "y") for page, url, html in [(1, None, None), (None, "u", "<p>x"), (2, "u", long)]] if rows else []
    spark.createDataFrame(pages, "page_id long, url string, html string, text string, number long, payload string").write.parquet(f"{folder}/pages.parquet")
    for name, query in QUERIES.items():
        if name.startswith(("op11_", "op12_")):  # on conversations: see test_conversations_packing
            continue
        if name.startswith("op13_"):
            pieces = query(spark, folder).collect()
            assert sum(r.start == 0 for r in pieces) == len(rows)
            continue
        wanted = len(pages) if name.startswith(("op1_", "op7_")) else len(rows)
        assert query(spark, folder).count() == wanted, name
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        out.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == len(rows)
    unique = corpus_pipeline.near_duplicates(spark, docs, folder).collect()
    assert len([r for r in unique if r.doc_id == 1]) == bool(rows)
