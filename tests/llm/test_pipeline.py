"""The pipeline's stages one after the other on small documents."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from test_operators import WORD, jaccard_classes, removed_lines

import corpus_pipeline as cp
from linkloom.llm import language_id, line_dedup
from linkloom.llm.queries import tokenizer

LAST = 10**9  # stands for a null id, which comes last


def test_stages_and_their_effects(spark):
    r = random.Random(1)
    say = lambda words, n: " ".join(r.choice(words.split()) for _ in range(n))
    base = say("the and thing over when where", 80)
    rows = [(0, base, "en", "a"), (1, base, "en", "a"), (2, "12 34", "en", "a"), (3, None, None, None)] + [(10 + i, say("le une être aussi dans", 40) + f"\nshared line here {i % 2}", "fr", "b") for i in range(8)]
    docs = spark.createDataFrame([(i, t, la, s, len(t or "")) for i, t, la, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    one = cp.language(spark, docs, "")
    assert one.columns == docs.columns and {x["doc_id"] for x in one.collect()} == {0, 1, *range(10, 18)}
    two = cp.lines(spark, one, "").collect()
    assert len(two) == 10 and next(x for x in two if x["doc_id"] == 1)["text"] == "" and sum("shared line" in x["text"] for x in two) == 2
    three = cp.near_duplicates(spark, docs, "")
    assert three.columns == docs.columns and {x["doc_id"] for x in three.collect()} == {0, 2, 3, *range(10, 18)}
    four = cp.mixed(spark, docs, "")
    assert four.columns == docs.columns and four.count() > 0 and four.where("text is null").count() == 0
    five = cp.tokens(spark, docs, "").collect()
    assert len(five) == len(rows) and {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(five[0].asDict())
    for _, stage in cp.STAGES[:4]:
        assert stage(spark, docs.limit(0), "").count() == 0


def test_documents_stay_when_no_language_is_labelled(spark):
    rows = [(1, "some words", None), (2, None, None), (3, "12 34", None), (4, "", None), (5, "\u4e2d\u6587", None), (None, "more words", None)]
    docs = spark.createDataFrame([(i, t, la, "a", 1) for i, t, la in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = cp.language(spark, docs, "")
    assert got.columns == docs.columns and {x["doc_id"] for x in got.collect()} == {1, 5, None}


def three_stages(rows):
    """rows(doc_id, text, lang, source) after language ID, line dedup and near-duplicates, one text at a time."""
    counts = defaultdict(lambda: np.zeros(language_id.BUCKETS))
    for i, t, la, _ in rows:
        if t is not None and la is not None and (i == LAST or zlib.crc32(str(i).encode()) % 5):
            np.add.at(counts[la], language_id.trigrams(t), 1)
    names = sorted(counts)
    c = np.stack([counts[la] for la in names], 1) + 0.5
    model = language_id.Mixture(names, np.log(c / c.sum(0)))
    rows = [x for x in rows if model.infer(x[1])[0] != "und"]
    gone = removed_lines([(i, t) for i, t, *_ in rows])
    rows = [(i, "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone), la, s) for i, t, la, s in rows]
    first = jaccard_classes([(i, t) for i, t, *_ in rows])
    return [x for x in rows if first[x[0]] == x[0]]


def mixed(rows):
    """Each row as often as water filling says, which must be a whole number of times."""
    size = Counter()
    for _, t, _, s in rows:
        size[s] += len(WORD.findall(t))
    weight, full, total = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(size))}, set(), 1.5 * sum(size.values())
    while True:
        level = (total - sum(2 * size[s] for s in full)) / max(1, sum(weight[s] for s in size if s not in full))
        more = {s for s in size if s not in full and weight[s] * level >= 2 * size[s]}
        if not more:
            break
        full |= more
    times = {s: 2 if s in full else weight[s] * level / size[s] for s in size}
    assert all(x == int(x) for x in times.values()) and len(set(times.values())) > 1
    return [x for x in rows if WORD.search(x[1]) for _ in range(int(times[x[3]]))]


def test_run_as_brute_force_with_clashing_names(spark, tmp_path):
    from tokenizers import Tokenizer

    r = random.Random(3)
    abc = {"en": "the and thing over when where", "fr": "le une \u00eatre aussi dans", "de": "der und nicht sch\u00f6n"}
    say = lambda la, n: " ".join(r.choice(abc[la].split()) + str(r.randrange(400)) for _ in range(n))
    rows = []
    for i in range(24):
        la = ("en", "fr", "de")[i % 3]
        rows.append((i, "\n".join([say(la, 30), say(la, 12), f"a line that all the {la} documents share {i % 2}"]), la, "ab"[i % 2]))
    near = rows[4][1].split("\n")
    spread = " ".join(near).split()
    rows += [(30, rows[5][1], "de", "a"), (31, " ".join(spread[:-1] + ["other"]), "fr", "b"), (32, "12 34", "en", "a"), (33, None, "en", "a"), (34, "", None, "b"), (35, say("de", 20), None, "b"), (LAST, say("en", 25), "en", "a")]
    left = sum(len(WORD.findall(x[1])) for x in three_stages(rows))
    rows.append((40, " ".join(f"the{k}z" for k in range(left)), "en", "c"))
    want = three_stages(rows)
    assert left == sum(len(WORD.findall(x[1])) for x in want if x[3] != "c") and len(want) < len(rows) - 3
    library = Tokenizer.from_file(tokenizer())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    tokens = []
    for i, t, *_ in mixed(want):
        ids = library.encode(t, add_special_tokens=False).ids
        tokens.append((None if i == LAST else i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t.encode())))
    clash = ["lang_pred", "score", "languages", "n_lines_", "n_removed_", "removed_", "_doc", "copies", "_copy", "_head", "_taken"]
    names = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in clash)
    spark.createDataFrame([(None if i == LAST else i, t, la, s, len(t or ""), *range(len(clash))) for i, t, la, s in rows], names).write.parquet(f"{tmp_path}/documents.parquet")
    got = [(x["doc_id"], x["n_tokens"], x["ids_sha256"], x["decoded_sha256"]) for x in cp.run(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(tokens, key=repr)


def test_columns_of_the_same_name_are_handed_on(spark):
    docs = spark.createDataFrame([(1, "a b\na b", "p", 0.25, 7, 8)], "doc_id long, text string, lang_pred string, Score double, removed_ int, n_lines_ int")
    one = language_id.predict(docs, language_id.Mixture([], np.zeros((language_id.BUCKETS, 0)))).first().asDict()
    assert (one["lang_pred"], one["Score"], one["lang_pred_"], one["score_"], one["languages"]) == ("p", 0.25, "und", 0.0, [])
    two = line_dedup.dedup(docs).first().asDict()
    assert (two["text"], two["removed_"], two["n_lines_"], two["removed__"], two["n_lines__"], two["n_removed_"]) == ("a b", 7, 8, [1], 2, 1)
