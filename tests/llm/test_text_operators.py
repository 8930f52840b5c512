"""Each operator against brute force on small tables with nulls, empty and long texts, ties, repeats and clashing names."""

import collections
import contextlib
import hashlib
import math
import os
import re
import threading
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from jointspark.llm import bpe, lm, media, minhash, packing, pii, quality, store, substring, urls, warc
from jointspark.llm.queries import QUERIES, SQL

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def words(text):
    return WORD.findall(text or "")


def corpus():
    rng = np.random.default_rng(11)
    vocabulary = ["".join(rng.choice(list("abcdeé"), rng.integers(1, 6))) for _ in range(400)]
    texts = [" ".join(rng.choice(vocabulary, rng.integers(20, 160))) for _ in range(40)]
    passage = " ".join(rng.choice(vocabulary, 30))
    texts += [t + "\n" + passage for t in texts[:6]]
    base = texts[7].split()
    for k in range(8):
        edited = list(base)
        edited[(k * 3) % len(edited)] = f"Edit{k}"
        texts.append(" ".join(edited))
    texts += [texts[3], texts[3], "", None, " \t\n ", "one", "one two three four", "One Two Three Four", "the " * 70, "a b c d e f g h i j k l m " * 12]
    texts += ["café\u00a0x \u3000 日本語 <|endoftext|> end", "x" * 5000, "mail Bob.1@mail.example.com or +1 (848) 555-1373, 4111 1111 1111 1111 at 10.0.0.255.", "\n\n##\n##\nabc\nabc\n"]
    return [(i, t, "en", "s", len(t) if t is not None else None) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def collected(df):
    return {r["doc_id"]: r for r in df.collect()}


def components(rows, percent=85, width=5):
    sets = {}
    for i, t, *_ in rows:
        w = words(lower(t or ""))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and label[a] != label[b] and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    low = min(label[a], label[b])
                    label[a] = label[b] = low
                    changed = True
    return sets, label


def test_near_duplicates(docs, rows):
    sets, label = components(rows)
    got = collected(minhash.near_duplicates(docs))
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (len(sets[i]), label[i], label[i] == i) for i in sets}


def test_near_duplicates_of_a_large_group_are_dealt_in_blocks(spark):
    rng = np.random.default_rng(2)
    base = [f"w{k}" for k in rng.integers(0, 5000, 120)]
    rows = []
    for k in range(400):
        own = list(base)
        for at in rng.integers(0, 120, k % 4):
            own[at] = f"e{k}x{at}"
        rows.append((k, " ".join(own), "en", "s", 1))
    _, label = components(rows)
    got = collected(minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)))
    assert {i: r["component_id"] for i, r in got.items()} == label


def test_candidates_follow_the_similarity_sought():
    miss = lambda percent, t: sum(math.comb(32, k) * (percent / 100) ** k * (1 - percent / 100) ** (32 - k) for k in range(t))
    assert minhash.agreeing(85) == 16
    for percent in (36, 50, 80, 85, 99):
        t = minhash.agreeing(percent)
        assert miss(percent, t) <= 1e-6 < miss(percent, t + 1)
    for percent in (0, 35, 101):
        with pytest.raises(ValueError, match="minima"):
            minhash.agreeing(percent)


def test_pairs_at_fifty_percent_are_found(spark):
    rows = []
    for k in range(12):  # 66 of 126 shingles are shared
        own = [f"p{k}w{j}" for j in range(100)]
        rows += [(2 * k, " ".join(own), "en", "s", 1), (2 * k + 1, " ".join([*own[:70], *(f"q{k}w{j}" for j in range(30))]), "en", "s", 1)]
    _, label = components(rows, 50)
    assert label[1] == 0
    got = collected(minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), percent=50))
    assert {i: r["component_id"] for i, r in got.items()} == label


def test_null_ids_and_repeated_rows(spark):
    rows = [(None, "a b c d e f", "x", "y", 1), (None, "a b c d e f", "x", "y", 1), (1, "a b c d e f", "x", "y", 1), (1, "a b c d e f", "x", "y", 1), (2, "A B c d e f", "x", "y", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(None, None, True)] * 2 + [(1, 1, True)] * 2 + [(2, 1, False)], key=str)
    long = " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame([(None, long, "x", "y", 1), (3, long, "x", "y", 1), (3, long, "x", "y", 1), (4, long + " z", "x", "y", 1)], SCHEMA)
    got = sorted(((r["doc_id"], r["n_removed"]) for r in substring.without_repeats(docs).collect()), key=str)
    assert got == sorted([(None, 0), (3, 0), (3, 0), (4, 30)], key=str)


def test_quality_counts(docs, rows):
    got = collected(quality.judged(docs))
    for i, t, *_ in rows:
        t = t or ""
        w = words(t)
        often = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {k + j for k in range(len(w) - 2) if often[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if words(x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)))
        assert (r["n_dup_lines"], r["n_repeat_words"]) == (len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r["base_failed"] and r["kept"])
    assert {r["doc_id"] for r in quality.keep_good(docs).collect()} == {i for i, r in got.items() if r["kept"]}


def test_cascade_orders_by_rejection_per_cost(docs):
    featured = quality.with_words(docs, F.col("text"))
    featured = featured.select("*", *(c.alias(n) for n, c in quality.counts().items()))
    order = quality.ordered(featured, quality.default_rules({n: F.col(n) for n in quality.counts()}))
    gains = [share / cost for _, share, cost in order]
    assert gains == sorted(gains, reverse=True) and len(order) == 8


def test_url_rules_and_trees(spark):
    given = ["http://a.com/x", "http://Example.COM/en/1", "https://www.example.com/en/", "http://b.example.com/en/?q", "http://x.net/fr/a#b", "http://net/es/", "http://x.net/de/", "http://a.com", "no scheme", "", None, "http://q.org/%20?a=1&b=2", "x://h?p/q", "http://notexample.com/en/"]
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(given)] + [(99, f"http://s{k}.net/fr/{k}", "") for k in range(60)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in urls.judged(pages).collect()}
    for i, u in enumerate(given):
        m = re.search(r"://([^/?#]*)([^?#]*)", u or "")
        host, path = (lower(m[1]), m[2]) if m else ("", "")
        fits = [(h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda f: len(f[0])) if fits else (None, None)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] == (verdict or got[i]["verdict"]) and got[i]["verdict"] in ("allow", "block")


def test_trees_learn_a_held_out_rule():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 0)).astype(float)
    trees = urls.Trees.fit(x[:2000], y[:2000])
    assert ((trees.predict(x[2000:]) > 0) == (y[2000:] > 0)).mean() > 0.95


def test_language_model(docs, rows):
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, *_ in rows}
    tokens = {i: [*words(lower(t or "")), None] for i, t, *_ in rows}
    counts = collections.Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    got = collected(lm.scored(docs))
    for i, ws in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in ws))
        assert r["score"] <= 1e-9
    out = [r for i, r in got.items() if held[i]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_tree_retains_contexts_that_diverge_and_sums_to_one():
    tree = lm.Tree(100_000, 3, 0.5, np.array([5, 7, 9], np.uint64))
    counts = np.array([40_000.0, 30_000.0, 29_999.0])
    n = np.array([15_000, 20_000, 5_000, 18_000, 9_000, 3_000, 8_000, 11_000, 11_000])
    tree.extend(np.repeat([1, 2, 3], 3), np.tile([1, 2, 3], 3), n, counts)
    assert len(tree.levels[0][0]) == 3
    hashes = np.array([5, 5, 5, 7, 5, 9], np.uint64)
    p = tree.probabilities(hashes, np.array([0, 0, 2, 2, 4, 4]), np.array([4e4, 4e4, 4e4, 3e4, 4e4, 29_999.0]))
    assert p[1] + p[3] + p[5] == pytest.approx(1, abs=1e-3)
    plain = lm.Tree(100_000, 3, 0.5, np.array([5, 7, 9], np.uint64))
    plain.extend(np.repeat([1, 2], 3), np.tile([1, 2, 3], 2), np.array([16_000, 12_000, 12_000, 12_000, 9_000, 9_000]), counts)
    assert not len(plain.levels[0][0])


def suffix_tree_scores(train, texts):
    """Scores of ``texts`` by a tree of ``train`` with least counts 8 and 1 or 2, spelled out."""
    grams = collections.Counter(tuple(t[k - d : k + 1]) for t in train for k in range(len(t)) for d in range(min(k, 3) + 1))
    n = sum(len(t) for t in train)
    once, twice = (sum(1 for g, c in grams.items() if len(g) == 1 and c == k) for k in (1, 2))
    cut = min(max(once / (once + 2 * twice) if once else 0.5, 0.1), 0.9)
    types, listed, states = sum(len(g) == 1 for g in grams), min(2, max(1, 1e-6 * n)), {}

    def p(context, word):
        if not context:
            return (grams[word,] - cut) / n if grams[word,] else cut * types / n
        low = p(context[1:], word)
        if context not in states:
            return low
        total, rest = states[context]
        c = grams[(*context, word)]
        return ((c if c >= listed else 0) + (4 + rest) * low) / (total + 4)

    for depth in (1, 2, 3):
        nexts = collections.defaultdict(list)
        for g, c in grams.items():
            if len(g) == depth + 1:
                nexts[g[:-1]].append((g[-1], c))
        new = {}
        for context, found in nexts.items():
            total = sum(c for _, c in found)
            shown = [(c, p(context[1:], w)) for w, c in found if c >= listed]
            rest, free = total - sum(c for c, _ in shown), len(shown)
            gain = sum(c * np.log(c / (total * q)) for c, q in shown)
            gain += rest * np.log(rest / (total * max(1 - sum(q for _, q in shown), 1e-9))) if rest else 0
            if total >= min(8, max(2, 1e-4 * n)) and shown and 2 * gain > free + 4 * np.sqrt(2 * free) + 4:
                new[context] = (total, rest)
        states.update(new)
    return [sum(np.log10(p(tuple(t[max(k - 3, 0) : k]), w)) for k, w in enumerate(t)) for t in texts], states


def test_tree_grows_with_the_corpus(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{k}" for k in (rng.zipf(1.3, 500) % 3000)) for _ in range(400)]
    for k in range(14):  # a phrase of words that are otherwise absent, far below 1e-4 of the tokens
        texts[k * 20] += " rare phrase of seven words follows here"
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    tokens = [[*words(t), None] for t in texts]
    want, states = suffix_tree_scores([t for t, h in zip(tokens, held, strict=True) if not h], tokens)
    assert sum(not h for h in held) * 500 > 160_000 and ("rare",) in states and ("rare", "phrase", "of") not in states
    got = collected(lm.scored(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA)))
    assert [got[i]["score"] for i in range(len(texts))] == pytest.approx(want)


def test_blocks_and_turns_do_not_change_scores(spark, monkeypatch):
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{k}" for k in rng.zipf(1.4, rng.integers(0, 200)) % 100) for _ in range(120)]
    tokens = [[*words(t), None] for t in texts]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    want, states = suffix_tree_scores([t for t, h in zip(tokens, held, strict=True) if not h], tokens)
    assert {len(s) for s in states} == {1, 2, 3}
    monkeypatch.setattr(lm, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(lm, "PART_TOKENS", 500)
    got = collected(lm.scored(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA)))
    assert [got[i]["score"] for i in range(len(texts))] == pytest.approx(want)


def test_language_model_leaves_little_on_disk_at_once(spark, tmp_path):
    rng = np.random.default_rng(9)
    docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in rng.zipf(1.3, 1000) % 30_000), "en", "s", 1) for i in range(600)], SCHEMA)
    docs.coalesce(4).write.parquet(str(tmp_path / "docs"))
    folders = [*(str(d) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()), store.shared_folder(spark).removeprefix("file://")]

    def used():
        return sum(e.stat().st_size for top in folders for d, _, names in os.walk(top) for e in os.scandir(d) if e.name in names)

    def rows():
        stages = spark._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
        return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))

    floor, shuffled, peaks, over = used(), rows(), [0], threading.Event()

    def watch():
        while not over.is_set():
            with contextlib.suppress(OSError):  # a file may go meanwhile
                peaks.append(used())

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        lm.scored(spark.read.parquet(str(tmp_path / "docs"))).write.format("noop").mode("overwrite").save()
    finally:
        over.set()
        watcher.join()
    size = sum(p.stat().st_size for p in (tmp_path / "docs").glob("*.parquet"))
    assert rows() - shuffled < 600_000 / 10  # texts and parts, not grams
    assert max(peaks) - floor < 6 * size  # 4.5 as measured; 11.2 and 1,034,946 rows when grams were rows


def test_bpe_equals_the_library(docs, rows):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got, ids = collected(bpe.digests(docs, path)), collected(bpe.encoded(docs, path))
    for i, t, *_ in rows:
        want = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(want, skip_special_tokens=False)
        assert got[i]["n_tokens"] == len(want) and list(ids[i]["ids"]) == want
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_media_round_trip(docs, rows):
    got = collected(media.stored_texts(docs))
    for i, t, *_ in rows:
        raw = (t or "").encode()
        padded = raw + bytes(-len(raw) % 64) if raw else bytes(64)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(padded[-64:])


def test_image_forms(spark):
    pixels = np.random.default_rng(1).integers(0, 256, (5, 7, 3)).astype(np.uint8)
    assert (media.decode(media.encode_bmp(pixels)) == pixels).all()
    assert (media.decode(b"P6\n# note\n7 5\n255\n" + pixels.tobytes()) == pixels).all()
    grey = pixels[:, :, 0]
    assert (media.decode(media.encode_pgm(grey))[:, :, 0] == grey).all()
    assert (media.decode(b"P2 7 5 255 " + " ".join(map(str, grey.ravel())).encode())[:, :, 0] == grey).all()
    assert media.decode(b"P1\n3 2\n1 0 1\n0 1 0\n")[:, :, 0].tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode(b"P4\n3 2\n" + bytes([0b10100000, 0b01000000]))[:, :, 0].tolist() == [[0, 255, 0], [255, 0, 255]]
    assert np.allclose(media.area_resize(np.kron(np.arange(6.0).reshape(2, 3), np.ones((4, 4)))[:, :, None], 2, 3)[:, :, 0], np.arange(6.0).reshape(2, 3))
    table = spark.createDataFrame([(1, bytearray(media.encode_pgm(grey))), (2, bytearray(b"junk")), (3, None), (4, bytearray(b"P5\n9 9\n255\nshort"))], "id long, data binary")
    got = {r["id"]: r for r in media.tiles(table, "id", "data").collect()}
    assert got[1]["width"] == 7 and got[1]["error"] is None and all(got[k]["tile"] is None and got[k]["error"] for k in (2, 3, 4))


def test_packing(docs, rows):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    pieces = packing.packed(docs, path).collect()
    whole = {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t, *_ in rows}
    at = collections.defaultdict(list)
    for p in pieces:
        at[p["doc_id"]].append((p["start"], p["length"]))
        assert p["doc_tokens"] == len(whole[p["doc_id"]])
        assert p["ids_crc32"] == zlib.crc32(whole[p["doc_id"]][p["start"] : p["start"] + p["length"]].tobytes())
    for i, ids in whole.items():
        end = 0
        for start, length in sorted(at[i]):
            assert start == end
            end += length
        assert end == len(ids)
    by = collections.defaultdict(list)
    for p in pieces:
        by[p["sequence_id"]].append((p["offset"], p["length"]))
    for found in by.values():
        end = 0
        for offset, length in sorted(found):
            assert offset == end
            end += length
        assert end <= 1024


def test_packing_plan_covers_demand_near_the_bound():
    rng = np.random.default_rng(3)
    for units in (16, 64):
        demand = rng.integers(0, 40, units)
        plan = packing.plan(demand)
        assert (plan.counts @ plan.patterns == demand).all() and (plan.patterns @ np.arange(1, units + 1)).max() <= units
        room = []  # first fit by falling size
        for size in np.repeat(np.arange(units, 0, -1), demand[::-1]):
            fits = next((k for k, r in enumerate(room) if r >= size), None)
            if fits is None:
                room.append(units - size)
            else:
                room[fits] -= size
        assert (demand @ np.arange(1, units + 1)) / units <= plan.counts.sum() <= len(room) + units // 8
    assert len(packing.plan(np.zeros(8, np.int64)).counts) == 0


def test_arc_versions_and_conversion(spark):
    for version in (1, 2):
        data = warc.arc_open(version, "a", "20240101000000") + warc.arc_record(version, "http://x/a b", "20240102030405", b"one\n\nbody", "a", 0) + warc.arc_record(version, None, "2024", b"", "a", 9)
        found = list(warc.arc_records(data))
        assert [b for _, b in found] == [b"one\n\nbody", b""] and found[0][0]["URL"] == "http://x/a%20b"
        head, body = next(warc.warc_records(warc.warc_record(*found[0], 7, None)))
        assert body == b"one\n\nbody" and head["WARC-Date"] == "2024-01-02T03:04:05Z" and head["WARC-Type"] == "response"
        with pytest.raises(warc.ArcError):
            list(warc.arc_records(data[:-12] + b"x y z\n"))
    long, other = "p" * 999 + "é", "q" * 999
    rows = [(1, "u", long), (2, "u", long), (9, None, long), (3, "u", other), (4, "u", other), (5, "", None), (6, "a\nb", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in warc.archived(pages).collect()}
    for i, _, html in rows:
        raw = (html or "").encode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(raw), hashlib.sha1(raw).hexdigest())
    assert [(i, got[i]["record_type"], got[i]["refers_to"]) for i in sorted(got)] == [(1, "revisit", 9), (2, "revisit", 9), (3, "response", None), (4, "response", None), (5, "response", None), (6, "response", None), (9, "response", None)]


def test_personal_data(docs, rows):
    def brute(x):
        out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
        out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(p) <= 255 for p in m[0].split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x):
            d = [int(c) for c in m[0] if c.isdigit()][::-1]
            if 12 <= len(d) <= 19 and (sum(d[::2]) + sum(sum(divmod(2 * c, 10)) for c in d[1::2])) % 10 == 0:
                out.append((m.start(), 2, m.end()))
        return sorted(out + [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 9 <= sum(c.isdigit() for c in m[0]) <= 15])

    rng = np.random.default_rng(8)
    for _ in range(4000):
        x = "".join(rng.choice(list("a1.@+- ()9é\n%"), rng.integers(0, 50)))
        assert pii.base_spans(x) == brute(x)
    got = collected(pii.detected(docs))
    for i, t, *_ in rows:
        base = brute(t or "")
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(b[1] == j for b in base) for j in range(4)]
        assert got[i]["base_sha256"] == hashlib.sha256(pii.written(base).encode()).hexdigest()
        assert set(filter(None, pii.written(base).split(","))) <= set(filter(None, got[i]["spans"].split(",")))


def test_tagger_gradients_and_held_out_spans():
    tagger = pii.Tagger.new(hidden=3)
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, pii.N_CLASSES, (6, 2)), np.array([[0, 0], [1, 0], [2, 3], [2, 4], [0, 0], [0, 0]])
    _, g = tagger.gradients(x, y)
    for k in ("wf", "ub", "cf", "o", "q", "t"):
        at = tuple(n // 2 for n in tagger.p[k].shape)
        old = tagger.p[k].copy()
        losses = []
        for e in (1e-5, -1e-5):
            tagger.p[k] = old.copy()
            tagger.p[k][at] += e
            losses.append(tagger.gradients(x, y)[0])
        tagger.p[k] = old
        assert g[k][at] == pytest.approx((losses[0] - losses[1]) / 2e-5, abs=1e-4)
    texts = [f"call {'abc' * (k % 4)} +{k % 9 + 1} ({200 + k}) 555-{1000 + k} or u.{k}@mail{k % 7}.example.com from 10.{k % 200}.3.{k % 250} now" for k in range(160)]
    pairs = [(pii.windows(t, s), pii.labels(pii.base_spans(t), s)) for t in texts for s in [pii.window_starts(t)]]
    x, y = (np.concatenate([p[k] for p in pairs]) for k in range(2))
    tagger = pii.Tagger.new()
    tagger.fit(x[:240], y[:240], steps=120)
    tags, want = tagger.tags(x[240:]), y[240:]
    assert (tags == want)[want > 0].mean() > 0.9


def without(rows):
    first, out = {}, {}
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        w = words(t)
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    for i, t, *_ in rows:
        w = words(t)
        gone = {k + j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(13)}
        out[i] = [x for k, x in enumerate(w) if k not in gone], len(gone)
    return out


def test_substring_removal(docs, rows):
    got = collected(substring.without_repeats(docs))
    for i, (kept, gone) in without(rows).items():
        assert (got[i]["n_words"], got[i]["n_removed"]) == (len(kept) + gone, gone)
        assert got[i]["kept_sha256"] == hashlib.sha256(" ".join(kept).encode()).hexdigest()
    spans = substring.repeated_spans(docs).collect()
    by = {i: words(t) for i, t, *_ in rows}
    for s in spans:
        n = s["windows"] + 12
        assert s["source"] < s["doc_id"] and by[s["doc_id"]][s["start"] : s["start"] + n] == by[s["source"]][s["source_start"] : s["source_start"] + n]


def test_pipeline_stages(spark, docs, rows):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["quality", "near_duplicates", "repeats", "personal_data", "packing"]
    stage = {n: f for n, f in p.STAGES}
    assert all(stage[n](spark, docs, "").columns == docs.columns for n in ("quality", "near_duplicates", "repeats", "personal_data"))
    _, label = components(rows)
    assert {r["doc_id"] for r in stage["near_duplicates"](spark, docs, "").collect()} == {i for i, c in label.items() if i == c}
    got = collected(stage["repeats"](spark, docs, ""))
    for i, (kept, gone) in without(rows).items():
        assert got[i]["text"] == (" ".join(kept) if gone else next(t for j, t, *_ in rows if j == i))
    masked = collected(stage["personal_data"](spark, docs, ""))
    text = next(r["text"] for r in masked.values() if r["text"] and "mail <" in r["text"])
    assert "@" not in text and "<EMAIL>" in text and "<PHONE>" in text and "<CARD>" in text and "<IP>" in text


def test_empty_tables(spark, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for df in (minhash.near_duplicates(empty), quality.judged(empty), lm.scored(empty), bpe.digests(empty, public_tokenizers.path("word_bpe_49k.json")), media.stored_texts(empty), packing.packed(empty, path), pii.detected(empty), substring.without_repeats(empty), urls.judged(pages), warc.archived(pages)):
        assert df.count() == 0


def test_clashing_columns_are_ignored(spark):
    clash = spark.createDataFrame([(1, "a b c d e f g", 5, 6, 7)], "doc_id long, text string, id long, n_words long, token long")
    assert minhash.near_duplicates(clash).first()["n_shingles"] == 3
    assert quality.judged(clash).first()["n_words"] == 7
    assert quality.keep_good(clash).columns == clash.columns
    assert substring.without_repeats(clash).first()["n_removed"] == 0
    assert lm.scored(clash).first()["n_tokens"] == 8
    assert pii.masked(clash).first()["text"] == "a b c d e f g"


def test_registry():
    assert {q.split("_")[0] for q in QUERIES} == {*(f"op{k}" for k in range(1, 11)), "pipeline"} and set(SQL) <= set(QUERIES)


def test_byte_level_ids_equal_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    worker, library = packing.ByteLevelIds(path), Tokenizer.from_file(path)
    assert worker.fast is not None
    rng = np.random.default_rng(6)
    letters = list("abcdefgst' \n\t\r\x1c\x85 　​09.,-é日本кЖα한\U0001f600") + ["<|endoftext|>", "the", "ing"]
    texts = ["".join(rng.choice(letters, rng.integers(0, 80))) for _ in range(3000)] + ["x" * 200_000, " " * 200_000]
    for t, ids in zip(texts, worker.encode(texts), strict=True):
        assert ids == np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
