"""Quality rules against plain Python counts."""
import re
from collections import Counter

from touchline.llm.quality_rules import RULES, STOP_WORDS, Rule, apply_rules, measures
from llm_tables import documents

CLEAN = ("The cat of the house went to the garden and it was a day that I will remember for long, "
         "as the sun was on the wall and the dog was in the shade of an old tree by the gate.")


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 8)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_measures_equal_plain_counts(spark):
    texts = [None, "", " \n\t ", "a", "a " * 9, CLEAN, (CLEAN + "\n") * 3, "x\ny\nx\n\n y\nx", "#*$%&|<> &&",
             "one two three four five six seven eight " * 2, " word \U0001F600\U0001F600 \x0bb\x0cc",
             " ".join(f"w{i}" for i in range(20)) + " end " + " ".join(f"w{i}" for i in range(20)),
             "a b a b a b a b a b", " ".join(str(i * i % 37) for i in range(3000)), "long " * 20000]
    got = {r["doc_id"]: r for r in measures(documents(spark, list(enumerate(texts)))).collect()}
    for i, text in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == plain(text), i


def test_verdicts_name_the_broken_rules(spark):
    junk = " ".join(w + "###" for w in CLEAN.split())
    texts = {1: CLEAN, 2: junk, 3: CLEAN.upper(), 4: " ".join(f"zq{i}xv" for i in range(40)), 5: None, 6: "too short",
             7: "\n".join(["- the one of it"] * 1 + [f"- the {i} of it and to" for i in range(9)]), 8: (CLEAN + " ") * 3}
    out = {r["doc_id"]: r for r in apply_rules(documents(spark, list(texts.items()))).collect()}
    assert out[1]["kept"] and out[1]["broken_rules"] == ""
    assert "symbols" in out[2]["broken_rules"] and not out[2]["kept"]
    assert out[3]["broken_rules"] == "upper_case" and out[4]["broken_rules"] == "stop_words"
    assert out[5]["base_failed"] and out[6]["base_failed"] and not out[6]["kept"]
    assert "bullet_lines" in out[7]["broken_rules"] and out[8]["base_failed"]


def test_own_table_and_clashing_columns(spark):
    docs = documents(spark, [(1, "a b c"), (None, "x"), (1, "a b c")]).withColumnRenamed("lang", "words").withColumnRenamed("source", "n_words")
    out = apply_rules(docs, rules=[Rule("chars", "word_chars", "n_words", least=500, most=1000)]).collect()
    assert len(out) == 3 and {r["broken_rules"] for r in out} == {""}
    assert apply_rules(docs.limit(0)).count() == 0


def test_plan_has_neither_udf_nor_shuffle(spark):
    plan = apply_rules(documents(spark, [(1, CLEAN)]))._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Pandas" not in plan


def test_a_filter_on_the_verdict_does_not_repeat_the_work(spark):
    plan = apply_rules(documents(spark, [(1, CLEAN)])).filter("kept")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_distinct(_w") == 1


def test_clean_labelled_documents_are_kept(spark):
    d = "/root/testdata/sf0.01"
    good = spark.read.parquet(f"{d}/labels.parquet").filter("quality = 1 and toxic = 0").select("doc_id")
    out = apply_rules(spark.read.parquet(f"{d}/documents.parquet")).join(good, "doc_id").filter("not base_failed")
    assert out.filter("kept").count() >= 0.99 * out.count()
    assert len(STOP_WORDS) == 4 and len({r.name for r in RULES}) == len(RULES)
