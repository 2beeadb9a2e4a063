"""Each training-data operator on small rows: nulls, empty and long texts, ties, repeats, empty tables, clashing names,
and against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.llm import common, language_id, line_dedup, mixing, near_dedup, quality_bayes, quality_rules, queries, text_stats, token_counts, token_file, topk_search, trie_bpe

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, removed_ int, _text string, kept string"
WORD = re.compile(common.WORD)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer())


def docs(spark, rows):
    """rows of (doc_id, text, lang, source), with more columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, la, s, len(t or ""), 0.5, 1, "x", "y") for i, t, la, s in rows], DOCS)


def words(r, n, vocabulary=50):
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    r = random.Random(2)
    long = words(r, 30_000)
    return docs(spark, [(1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", "a"), (None, "one two three", "en", "b"), (4, long, "en", "a"), (5, "one two three", "fr", None), (5, "one two three", "fr", None), (6, "a <|endoftext|> b é中\U0001f642", "fr", "b"), (7, "don't  stop\r\n now\n\nx", None, "b")])


def test_text_statistics_by_brute_force(spark):
    r = random.Random(1)
    rows = [(i, "\n".join(words(r, r.randrange(6), 4) for _ in range(r.randrange(8))) + r.choice(["", "#*", " é<|>"]), "en", "a") for i in range(60)] + [(99, None, "en", "a")]
    got = {x["doc_id"]: x for x in text_stats.with_stats(docs(spark, rows), ["doc_id"]).collect()}
    for i, text, *_ in rows:
        t = text or ""
        w = WORD.findall(t)
        c = Counter(zip(w, w[1:], w[2:], strict=False))
        cover = {k + j for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        g = got[i]
        assert (g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(map(t.count, "#*$%&|<>")), len(lines) - len(set(lines)), len(cover))


def test_decision_list_learns_and_emits_conditions(spark):
    r = random.Random(3)
    rows = [(i, words(r, 80) if i % 3 else " ".join(f"w{r.randrange(50)}##" for _ in range(80)), "en", "a") for i in range(120)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 120, 2)] + [(None, 1), (4, None)], "doc_id long, quality int")
    out, found = quality_rules.judge(docs(spark, rows), labels)
    assert found.rules and {x["doc_id"]: x["kept"] for x in out.collect()} == {i: i % 3 > 0 for i in range(120)}


def test_decision_list_without_labels_keeps(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int")
    out, found = quality_rules.judge(odd, none)
    assert not found.rules and out.count() == 9 and out.where("kept").count() == 0  # short or repetitive: the base rules say no
    assert quality_rules.judge(odd.limit(0), none)[0].count() == 0


def test_site_posteriors_move_weak_evidence(spark):
    r = random.Random(4)
    rows, labels = [], []
    for i in range(300):
        host = "good" if i % 2 else "bad"
        bad = r.random() < (0.05 if host == "good" else 0.9)
        rows.append((i, " ".join(f"w{r.randrange(50)}" + ("##" if bad and k % 2 else "") for k in range(60)), "en", host))
        labels.append((i, int(not bad)))
    out = quality_bayes.classify(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    want = dict(labels)
    assert sum(x["kept"] == bool(want[x["doc_id"]]) for x in out) >= 295
    post = {h: [x["host_posterior"] for x in out if (x["doc_id"] % 2 == 1) == (h == "good")] for h in ("good", "bad")}
    assert min(post["good"]) > max(post["bad"])


def test_site_posteriors_on_odd_rows(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = quality_bayes.classify(odd, none).collect()
    assert len(out) == 9 and all(x["kept"] for x in out) and quality_bayes.classify(odd.limit(0), none).count() == 0


def test_language_mixture(spark, odd):
    r = random.Random(5)
    abc = {"en": "the and thing over", "fr": "le une être aussi", "de": "der und nicht schön"}
    say = lambda la, n: " ".join(r.choice(abc[la].split()) for _ in range(n))
    train = docs(spark, [(i, say(la, 30), la, "a") for i, la in enumerate(sorted(abc) * 20)] + [(900, None, "en", "a"), (901, "x", None, "a")])
    model = language_id.learn(train)
    assert model.languages == ["de", "en", "fr"]
    lang, score, found = model.infer(say("fr", 60) + " " + say("de", 20))
    assert lang == "fr" and set(found) == {"fr", "de"} and 0.6 < score < 0.9
    got = {x["doc_id"]: (x["lang_pred"], x["score"]) for x in language_id.predict(docs(spark, [(1, None, None, "a"), (2, "", None, "a"), (3, "12 !? 3", None, "a"), (4, say("de", 5), None, "a")]).drop("score"), model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] == "de" and 0 <= got[4][1] <= 1
    empty = language_id.learn(train.limit(0))
    assert empty.infer("any text") == ("und", 0.0, [])
    assert language_id.predict(odd.drop("score"), empty).count() == 9
    ids = spark.range(50).select("id", language_id.held_out(F.col("id")).alias("h")).collect()
    assert all(x["h"] == (zlib.crc32(str(x["id"]).encode()) % 5 == 0) for x in ids)


def test_every_language_is_learned(spark):
    many = docs(spark, [(i, f"text of {i}", f"l{i:03}", "a") for i in range(505)])
    assert language_id.learn(many).languages == [f"l{i:03}" for i in range(505)]
    one_id = docs(spark, [(i if i else None, f"text {i} {k}", f"l{i}", "a") for i in range(10) for k in range(60)])
    assert language_id.learn(one_id, per_language=20).languages == [f"l{i}" for i in range(10)]
    same = docs(spark, [(1, "the same text", f"l{i}", "a") for i in range(10) for _ in range(60)])
    assert language_id.learn(same, per_language=20).languages == [f"l{i}" for i in range(10)]


def removed_lines(rows, t=0.8):
    seen, gone = [], set()
    for i, text in sorted(rows):
        for k, line in enumerate((text or "").split("\n")):
            s = frozenset(WORD.findall(line))
            if not s:
                continue
            if any(len(s & y) >= t * len(s | y) - 1e-9 for y in seen):
                gone.add((i, k))
            seen.append(s)
    return gone


@pytest.mark.parametrize("few", [False, True])
def test_line_dedup_by_brute_force(spark, monkeypatch, few):
    if few:  # centres and representatives at work
        monkeypatch.setattr(line_dedup, "FREQUENT", 1)
        monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", 0)
    r = random.Random(6)
    base = [[f"t{r.randrange(60)}" for _ in range(n)] for n in (1, 2, 5, 9, 12, 20, 130, 240)]

    def line():
        w = list(r.choice(base))
        for _ in range(r.randrange(0, 1 + len(w) // 8)):
            w[r.randrange(len(w))] = f"t{r.randrange(60)}"
        return " ".join(w)

    rows = [(i, "\n".join(line() if r.random() < 0.9 else "" for _ in range(r.randrange(1, 6)))) for i in range(40)] + [(100, None), (101, "")]
    got = line_dedup.dedup(docs(spark, [(i, t, "en", "a") for i, t in rows])).collect()
    gone = removed_lines(rows)
    text = dict(rows)
    for x in got:
        want = None if text[x["doc_id"]] is None else "\n".join(s for k, s in enumerate(text[x["doc_id"]].split("\n")) if (x["doc_id"], k) not in gone)
        assert x["text"] == want and x["n_chars"] == (None if want is None else len(want))


def test_line_dedup_counts_a_share_of_the_lines(spark, monkeypatch):
    def classes(rows):
        many = spark.createDataFrame(rows, "_doc long, text string")
        return [c for c in spark.range(1).select(line_dedup.frequency_classes(many, 10).alias("c")).first()["c"] if c]

    short, long = [(i, "word\n \n word ") for i in range(4000)], [(7, "word\n" * 40_000)]
    for rows, lines in ((short, 8000), (long, 40_000)):
        (c,) = classes(rows)
        assert 8 * math.log2(lines / 10) <= c <= 8 * math.log2(lines / 6.5)
    # the counters order tokens only: without any the same lines go
    monkeypatch.setattr(line_dedup, "COUNTED", 0)
    assert classes(short) == []
    r = random.Random(16)
    base = [[f"t{r.randrange(40)}" for _ in range(n)] for n in (1, 3, 10, 40, 150)]
    text = lambda: "\n".join(" " * r.randrange(3) + "  ".join(r.sample(w, len(w) - r.randrange(1 + len(w) // 8))) + " " * r.randrange(2) for w in r.choices(base, k=r.randrange(6)))
    rows = [(i, text()) for i in range(30)]
    gone = removed_lines(rows)
    for x in line_dedup.dedup(docs(spark, [(i, t, "en", "a") for i, t in rows]).drop("removed_")).collect():
        assert x["removed_"] == sorted(k for i, k in gone if i == x["doc_id"])
        assert x["n_lines_"] == len(rows[x["doc_id"]][1].split("\n")) and x["n_removed_"] == len(x["removed_"])


def test_line_dedup_on_odd_rows(spark, odd):
    got = line_dedup.dedup(odd.drop("removed_")).collect()
    by = defaultdict(list)
    for x in got:
        by[x["doc_id"]].append(x["text"])
    assert len(got) == 9 and by[5] == ["one two three"] * 2 and by[None] == [""] and by[1] == [None] and by[3] == [" \n\t "]
    assert line_dedup.dedup(odd.drop("removed_").limit(0)).count() == 0


def jaccard_classes(rows, t=0.8):
    sets = [set(near_dedup.shingles(x)[0].tolist()) for _, x in rows]
    head = list(range(len(rows)))

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j]) - 1e-9:
                a, b = find(i), find(j)
                head[max(a, b)] = min(a, b)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    return {d: min(least[find(i)]) for i, (d, _) in enumerate(rows)}


def test_near_duplicates_by_brute_force(spark):
    r = random.Random(8)
    base = [[f"t{r.randrange(500)}" for _ in range(120)] for _ in range(4)]
    rows = []
    for i in range(70):
        w = list(base[i % 4]) if i < 60 else [f"u{r.randrange(500)}" for _ in range(60)]
        for _ in range(r.randrange(0, 5)):
            w[r.randrange(len(w))] = f"x{r.randrange(9999)}"
        rows.append((i, " ".join(w)))
    rows += [(200, "a b"), (201, "a b"), (202, None), (203, "")]
    got = {x["doc_id"]: x["class_id"] for x in near_dedup.classes(docs(spark, [(i, t, "en", "a") for i, t in rows])).collect()}
    assert got == jaccard_classes(rows)


def test_near_duplicates_on_odd_rows(spark, odd):
    got = near_dedup.classes(odd).collect()
    assert len(got) == 9 and {x["class_id"] for x in got if x["doc_id"] in (None, 5)} == {5} and near_dedup.classes(odd.limit(0)).count() == 0


def test_parity_bitmaps_bound_the_difference():
    r = np.random.default_rng(19)
    for _ in range(50):
        a, b = (near_dedup.mix64(np.unique(r.integers(0, 400, r.integers(1, 300))).astype(np.uint64)) for _ in range(2))
        bits = sum((int(x) ^ int(y)).bit_count() for x, y in zip(near_dedup.parity(a).view(np.uint64), near_dedup.parity(b).view(np.uint64), strict=True))
        assert bits <= len(set(a.tolist()) ^ set(b.tolist()))


def test_darts_estimate_weighted_jaccard():
    r = np.random.default_rng(9)
    e = near_dedup.mix64(np.arange(300, dtype=np.uint64))
    a, b = r.integers(1, 9, 300).astype(float), r.integers(1, 9, 300).astype(float)
    x, y = near_dedup.dart_signature(e, a, 2000), near_dedup.dart_signature(e, b, 2000)
    assert abs((x == y).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.04
    s, u = near_dedup.dart_signature(e[:200], None, 2000), near_dedup.dart_signature(e[50:250], None, 2000)
    assert abs((s == u).mean() - 150 / 250) < 0.04


def test_mixing_targets_and_masses(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEAF", 8)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    r = random.Random(10)
    rows = [(i, words(r, r.randrange(1, 40)), "en", r.choice(["a", "b", "c", "dd", None])) for i in range(300)] + [(500, None, "en", "a"), (501, "", "en", "e")]
    got = mixing.mix(docs(spark, rows)).collect()
    again = mixing.mix(docs(spark, rows)).collect()
    assert sorted((x["doc_id"], x["taken"]) for x in got) == sorted((x["doc_id"], x["taken"]) for x in again) and len(got) == 302
    size, taken, target = Counter(), Counter(), {}
    for x in got:
        assert x["size"] == len(WORD.findall(dict((a, b) for a, b, *_ in rows)[x["doc_id"]] or "")) and 0 <= x["taken"] <= 2 * x["size"]
        size[x["source"]] += x["size"]
        taken[x["source"]] += x["taken"]
        target[x["source"]] = x["target"]
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight, want, total = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, {}, 1.5 * sum(size.values())
    open_ = set(order)
    while True:
        level = (total - sum(want.values())) / max(1, sum(weight[s] for s in open_))
        full = {s for s in open_ if weight[s] * level >= 2 * size[s]}
        if not full:
            break
        want |= {s: 2.0 * size[s] for s in full}
        open_ -= full
    want |= {s: weight[s] * level for s in open_}
    for s in order:
        assert math.isclose(target[s], want[s], abs_tol=1e-6) and abs(taken[s] - target[s]) <= 40
    assert mixing.mix(docs(spark, rows).limit(0)).count() == 0


def test_mixing_on_odd_rows(spark, odd):
    assert mixing.mix(odd).count() == 9


def expected_ids(library, texts):
    return [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_trie_encodes_as_the_library(spark, odd, library):
    rows = [(x["doc_id"], x["text"]) for x in odd.collect()]
    got = sorted(((x["doc_id"] or 0, x["n_tokens"], x["ids_sha256"], x["decoded_sha256"]) for x in trie_bpe.encode(odd, queries.tokenizer()).collect()))
    want = sorted((d or 0, len(i), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(i, skip_special_tokens=False).encode()).hexdigest()) for (d, _), i in zip(rows, expected_ids(library, [t for _, t in rows]), strict=True))
    assert got == want and trie_bpe.encode(odd.limit(0), queries.tokenizer()).count() == 0


def test_encoders_on_random_texts(library):
    r = random.Random(11)
    parts = [" ", "  ", "\n", "\n\n", "\t", "\r\n", " ", "　", "\x1c", "\x00", "don't", "'s", "The", "é", "中文", "12", ",", "!!", "<|endoftext|>", "<|endof", "\U0001f642", "x" * 60, "_"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(25))) for _ in range(1500)]
    want = [np.array(i, "<u4").tobytes() for i in expected_ids(library, texts)]
    from linkloom.llm.pieces import PieceEncoder

    for kind in (PieceEncoder, trie_bpe.TrieBPE):
        assert list(kind(queries.tokenizer()).encode_many(texts)) == want


def test_token_counts_and_cache(spark, odd, library, tmp_path):
    cache = f"file://{tmp_path}/cache"
    want = sorted((x["doc_id"] or 0, len((x["text"] or "").encode()), len(i), len(i) > 512) for x, i in zip(odd.collect(), expected_ids(library, [x["text"] for x in odd.collect()]), strict=True))
    run = lambda: sorted((x["doc_id"] or 0, x["n_bytes"], x["n_tokens"], x["over_limit"]) for x in token_counts.count_tokens(odd, queries.tokenizer(), cache).collect())
    assert run() == want
    stored = spark.read.parquet(cache).count()
    assert stored == 6 and run() == want and spark.read.parquet(cache).count() == stored  # a second run only hits
    assert token_counts.count_tokens(odd.limit(0), queries.tokenizer(), cache).count() == 0


@pytest.mark.parametrize("parts", [1, 5])
def test_token_file_round_trip(spark, library, tmp_path, monkeypatch, parts):
    monkeypatch.setattr(token_file, "BLOCK_TOKENS", 3000)
    r = random.Random(12)
    rows = [(i * 3, words(r, r.randrange(400)), "en", "a") for i in range(80)] + [(400, None, "en", "a"), (401, "", "en", "a")]
    shuffled = rows[:]
    r.shuffle(shuffled)
    df = docs(spark, shuffled if parts > 1 else rows).repartition(parts) if parts > 1 else docs(spark, rows)
    path = token_file.write_tokens(df, queries.tokenizer(), f"file://{tmp_path}/t")
    got = token_file.read_tokens(spark, path, with_ids=True).orderBy("doc_id").collect()
    at = 0
    for x, (i, *_), ids in zip(got, rows, expected_ids(library, [t for _, t, *_ in rows]), strict=True):
        raw = np.array([*ids, 0], "<u4").tobytes()
        assert (x["doc_id"], x["start"], x["n_tokens"], x["ids_crc32"], bytes(x["ids"])) == (i, at, len(ids) + 1, zlib.crc32(raw), raw)
        at += len(ids) + 1


def test_token_file_on_odd_rows(spark, odd, tmp_path):
    assert token_file.read_tokens(spark, token_file.write_tokens(odd, queries.tokenizer(), f"file://{tmp_path}/o")).count() == 9
    assert token_file.read_tokens(spark, token_file.write_tokens(odd.limit(0), queries.tokenizer(), f"file://{tmp_path}/e")).count() == 0


def test_token_file_keeps_few_and_small_rows_together(spark, library, tmp_path):
    """A scan takes thousands of rows of a row group at once, so that these are an executor's memory."""
    import pyarrow.parquet as pq

    texts = [" ".join(["one two three"] * 20_000) for _ in range(40)]
    path = token_file.write_tokens(docs(spark, [(i, t, "en", "a") for i, t in enumerate(texts)]).coalesce(1), queries.tokenizer(), f"file://{tmp_path}/t")
    files = [pq.ParquetFile(f) for f in (tmp_path / "t" / "blocks").glob("*.parquet")]
    groups = [f.metadata.row_group(i) for f in files for i in range(f.metadata.num_row_groups)]
    assert sum(g.num_rows for g in groups) >= 10 and max(g.num_rows for g in groups) <= 8
    assert max(max(f.read(["n_tokens"])["n_tokens"].to_pylist()) for f in files if f.metadata.num_rows) * 2 < 1 << 19
    ids = np.array(expected_ids(library, texts[:1])[0] + [0], "<u4")
    got = token_file.read_tokens(spark, path).orderBy("doc_id").collect()
    assert [tuple(x) for x in got] == [(i, i * len(ids), len(ids), zlib.crc32(ids.tobytes())) for i in range(40)]


def test_token_file_sorts_what_does_not_ascend(spark, library, tmp_path):
    """Partitions that ascend, that only hold disjoint ids, and that overlap."""
    texts = [words(random.Random(i), 1 + i % 7) for i in range(40)]
    want, at = [], 0
    for i, ids in enumerate(expected_ids(library, texts)):
        want.append((i, at, len(ids) + 1, zlib.crc32(np.array([*ids, 0], "<u4").tobytes())))
        at += len(ids) + 1
    ascending = [*range(40)]
    for k, order in enumerate([ascending, [*range(9, -1, -1), *range(10, 40)], [*range(30, 40), *range(30)], ascending[::-1], ascending[::3] + ascending[1::3] + ascending[2::3]]):
        df = docs(spark, [(i, texts[i], "en", "a") for i in order])
        assert df.rdd.getNumPartitions() == 4
        got = token_file.read_tokens(spark, token_file.write_tokens(df, queries.tokenizer(), f"file://{tmp_path}/{k}")).orderBy("doc_id").collect()
        assert [tuple(x) for x in got] == want


def test_memo_is_cut_to_the_frequent_pieces(library, monkeypatch):
    from linkloom.llm import pieces

    for name, value in {"KEYS_AT_ONCE": 7, "WORDS_AT_ONCE": 5}.items():
        monkeypatch.setattr(pieces, name, value, raising=False)
    for kind in (pieces.PieceEncoder, trie_bpe.TrieBPE):
        for name, value in {"CHUNK": 300, "MEMO": 30, "KEPT": 10}.items():
            monkeypatch.setattr(kind, name, value, raising=False)
    r = random.Random(13)
    rare = lambda: "".join(r.choice("abcdeéßñ") for _ in range(r.randrange(3, 9))) + r.choice(["", "", ",", ".", "%%", "'s", "x" * 60])
    texts = [" ".join(r.choice(["the", "of\nthe", "and,", rare(), *([rare() + "<|endoftext|>", "of  it"] if i % 4 == 0 else [])]) for _ in range(r.randrange(60))) for i in range(200)]
    want = [np.array(i, "<u4").tobytes() for i in expected_ids(library, texts)]
    for kind in (pieces.PieceEncoder, trie_bpe.TrieBPE):
        e = kind(queries.tokenizer())
        assert list(e.encode_many(texts)) == want
        known = e.known.to_pylist()
        assert {"the", "and,", "\nthe"} <= set(known) and len(known) <= 30 and max(map(len, known)) <= 48
        assert len(set(known)) == len(known) == len(e.sizes) == len(e.hits) and len(e.flat) == e.sizes.sum()


def test_blocks_decode_by_segment_and_know_damage(monkeypatch):
    monkeypatch.setattr(token_file, "LANES", 16)
    monkeypatch.setattr(token_file, "INTERVAL", 8)
    ids = np.random.default_rng(13).zipf(1.3, 3001).clip(max=5000).astype(np.uint32)
    coder = token_file.Coder(token_file.normalised(np.bincount(ids, minlength=5001)))
    payload = token_file.pack(coder, 0, 0, 0, np.array([1], np.int64), np.array([3001], np.uint32), ids)
    assert (token_file.unpack(coder, payload)[4] == ids).all()
    assert (token_file.unpack(coder, payload, only=[3])[4] == ids[3 * 128 : 4 * 128]).all()
    with pytest.raises(ValueError):
        token_file.unpack(coder, payload[:200] + bytes([payload[200] ^ 1]) + payload[201:])


def test_search_is_exact_beyond_doubles(spark):
    r = np.random.default_rng(15)
    v = r.integers(2**27, 2**28, (60, 4))
    df = spark.createDataFrame([(i, [float(c) / 1024 for c in x]) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = topk_search.search(df, F.col("vec_id") % 20 == 0).collect()
    for a in (0, 20, 40):
        best = sorted((-sum(int(p) * int(q) for p, q in zip(v[a], v[b], strict=True)), b) for b in range(60) if b != a)[:10]
        assert [(x["vec_id"], x["score"]) for x in sorted(got, key=lambda x: x["rank"]) if x["query_id"] == a] == [(b, -s) for s, b in best]


def test_signs_are_no_letters():
    assert not any(map(language_id.has_letter, ["\u24d0\u24b6", "\u2167", "12 !", ""])) and language_id.has_letter("1\u4e2d")


def test_labelled_sample_counts_rows(spark):
    rows = [(1, words(random.Random(i), 60), "en", "a") for i in range(500)] + [(2, "one text", "en", "a")] * 300
    stats = text_stats.with_stats(docs(spark, rows), ["doc_id"])
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert quality_rules.labelled_sample(stats, labels, most=100).count() < 200


def test_rules_decide_as_the_list(spark):
    r = random.Random(21)
    rows = [(i, " ".join(f"w{r.randrange(60)}" + ("#" if r.random() < (0.6 if i % 4 == 0 else 0.05) else "") for _ in range(r.choice([20, 70]))), "en", "a") for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(200)], "doc_id long, quality int")
    out, found = quality_rules.judge(docs(spark, rows), labels)
    names = list(quality_rules.RATIOS)
    seen = out.select("doc_id", "n_words", "n_repeat_words", "base_failed", "kept", *[quality_rules.ratio(n).alias(f"r_{n}") for n in names]).collect()
    verdict = found.predict(np.array([[x[f"r_{n}"] for n in names] for x in seen], float), names)
    for x, v in zip(seen, verdict, strict=True):
        base = x["n_words"] < 50 or 100 * x["n_repeat_words"] > 50 * x["n_words"]
        assert x["base_failed"] == base and x["kept"] == (not base and bool(v))
    assert found.rules and len({x["kept"] for x in seen}) == 2


def test_site_posteriors_by_brute_force(spark):
    r = random.Random(22)
    rows = [(i, " ".join(f"w{r.randrange(60)}" + ("#" if r.random() < (0.5 if (i // 3) % 2 else 0.1) else "") for _ in range(60)), r.choice(["p", "q", None]), "abc"[i % 3]) for i in range(120)]
    labels = spark.createDataFrame([(i, int((i // 3) % 2 == 0)) for i in range(120)], "doc_id long, quality int")
    got = quality_bayes.classify(docs(spark, rows), labels).collect()
    p = {x["doc_id"]: x["evidence"] for x in got}
    host, path = defaultdict(list), defaultdict(list)
    for i, _, la, s in rows:
        host[s].append(p[i])
        path[s, la].append(p[i])

    def worth(groups):
        every = [x for g in groups for x in g]
        n, mean = len(every), sum(every) / len(every)
        inner = sum(len(g) * (sum(g) / len(g)) ** 2 for g in groups)
        within = max(1e-12, (sum(x * x for x in every) - inner) / max(1, n - len(groups)))
        between = ((inner - n * mean**2) - (len(groups) - 1) * within) / max(1e-12, n - sum(len(g) ** 2 for g in groups) / n)
        return mean, within / between if between > 1e-9 else 1e9

    mean, of_host = worth(list(host.values()))
    _, of_path = worth([[x - sum(host[s]) / len(host[s]) for x in g] for (s, _), g in path.items()])
    logit = lambda x: math.log((q := max(1e-4, min(1 - 1e-4, x))) / (1 - q))
    where = {i: (s, la) for i, _, la, s in rows}
    for x in got:
        s, la = where[x["doc_id"]]
        a = (sum(host[s]) - p[x["doc_id"]] + of_host * mean) / (len(host[s]) - 1 + of_host)
        b = (sum(path[s, la]) - p[x["doc_id"]] + of_path * a) / (len(path[s, la]) - 1 + of_path)
        q = 1 / (1 + math.exp(-(logit(p[x["doc_id"]]) + logit(b) - logit(mean))))
        assert math.isclose(x["host_posterior"], a, rel_tol=1e-6) and math.isclose(x["path_posterior"], b, rel_tol=1e-6) and math.isclose(x["quality"], q, rel_tol=1e-6)


def test_mixture_by_plain_expectation_maximisation():
    r = np.random.default_rng(23)
    model = language_id.Mixture(["a", "b", "c"], np.log(r.dirichlet(np.full(language_id.BUCKETS, 0.01) + 1e-3, 3).T + 1e-9))
    text = "the quick brown fox jumps over the lazy dog and runs away from all of them " * 3
    grams = language_id.trigrams(text)
    pi = [1 / 3] * 3
    for _ in range(15):
        part = [0.0] * 3
        for g in grams:
            w = [pi[k] * model.p[g, k] for k in range(3)]
            for k in range(3):
                part[k] += w[k] / sum(w)
        new = [(x + 1) / (len(grams) + 3) for x in part]
        done = max(abs(x - y) for x, y in zip(new, pi, strict=True)) < 1e-4
        pi = new
        if done:
            break
    lang, score, _ = model.infer(text)
    assert lang == "abc"[int(np.argmax(pi))] and math.isclose(score, max(pi), rel_tol=1e-9)


def test_search_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "BUCKET", 7)
    r = np.random.default_rng(14)
    v = r.normal(size=(150, 8)) * r.choice([0.1, 1.0, 5.0], 150)[:, None]
    v[20:30] = v[19]
    rows = [(i, [float(c) for c in x]) for i, x in enumerate(v)] + [(500, None), (600, [1.0, None] + [0.0] * 6), (700, [float("nan")] + [0.0] * 7), (800, []), (900, [0.0] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).withColumn("rank", F.lit("x"))
    got = topk_search.search(df, F.col("vec_id") % 5 == 0).collect()
    ids = [*range(150), 900]
    q = np.floor(np.vstack([v, np.zeros((1, 8))]) * 1024).astype(np.int64)
    for a in [i for i in range(151) if ids[i] % 5 == 0]:
        best = sorted((-int(q[a] @ q[b]), ids[b]) for b in range(151) if b != a)[:10]
        assert [(x["vec_id"], x["score"]) for x in sorted(got, key=lambda x: x["rank"]) if x["query_id"] == ids[a]] == [(b, -s) for s, b in best]
    assert topk_search.search(df.limit(0), F.col("vec_id") % 5 == 0).count() == 0
