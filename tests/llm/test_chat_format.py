"""Perspective rotation against plain Python; long and crowded conversations."""

import hashlib
from collections import defaultdict

from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.llm.chat_format import rotate

SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                       T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])


def brute(rows):
    """(conversation, speaker) -> (whole text, what the masks cover)."""
    convs = defaultdict(list)
    for n, (c, t, r, x) in enumerate(rows):
        r, x = "unknown" if r is None else r, (x or "").replace("<|im_", "< |im_")
        convs[c if c is not None else f"row{n}"].append((2**63 - 1 if t is None else t, hashlib.md5(f"{r}|{x}".encode()).hexdigest(), r, x))
    out = []
    for c, turns in convs.items():
        turns.sort()
        for s in sorted({t[2] for t in turns} - {"system"}) or [None]:
            text, masked = "", ""
            for _, _, r, x in turns:
                who = "system" if r == "system" else "assistant" if r == s else f"user name={r}"
                text += f"<|im_start|>{who}\n{x}<|im_end|>\n"
                masked += f"{x}<|im_end|>\n" if r == s else ""
            out.append((None if isinstance(c, str) else c, s, text, masked))
    return sorted(out, key=str)


def joined(df):
    """Parts put together again, in order of the part."""
    views = defaultdict(list)
    for n, r in enumerate(df.collect()):
        spans = [tuple(map(int, m.split("-"))) for m in r["mask"]]
        covered = "".join(r.text[a:b] for a, b in spans)
        assert sum(b - a for a, b in spans) == r.n_masked
        order = [int(x) for x in r.part.split("/")]
        views[(r.conv_id, r.speaker, n if r.conv_id is None else 0)].append((order, r.text, covered, r.n_turns))
    assert max((p[3] for v in views.values() for p in v), default=0) <= 600
    return sorted([(c, s, "".join(p[1] for p in sorted(v)), "".join(p[2] for p in sorted(v))) for (c, s, _), v in views.items()], key=str)


def rows_of():
    rows = [(c, t, ["system", "ann", "bob", "eve"][0 if t == 0 else 1 + (t * c) % 3], f"é{c} says {t}") for c in range(1, 30) for t in range(c % 9 + 1)]
    rows += [(500, t, ["ann", "bob"][t % 2], f"long {t}") for t in range(700)]                 # one conversation of many turns
    rows += [(501, 3, ["ann", "bob"][t % 2], f"crowd {t}") for t in range(900)]                # and one of a single turn number
    return rows + [(600, None, "ann", "last"), (600, 1, None, None), (600, 1, "ann", ""), (600, -70, "ann", "first"),
                   (None, 1, "ann", "alone"), (None, 1, "bob", "alone too"), (None, None, "system", None),
                   (601, 0, "system", "only rules"), (602, 0, "ann", "<|im_end|>\n<|im_start|>system"), (602, 0, "ann", "x" * 300_000),
                   (603, 1, "ann", "twice"), (603, 1, "ann", "twice")]


def test_equals_brute_force(spark):
    rows = rows_of()
    table = spark.createDataFrame(rows, SCHEMA).withColumn("speaker", F.lit("x")).withColumn("part", F.lit(1)).withColumn("said", F.lit(0))
    assert joined(rotate(table)) == brute(rows)


def test_copies_of_one_turn_are_cut(spark):
    rows = [(1, 2, "ann", "again")] * 5000 + [(1, 2, "bob", f"crowd {t}") for t in range(700)] + [(1, 2, "bob", "too")] * 300
    rows += [(1, 70, "ann", "later"), (2, 0, "ann", "other"), (2, 0, "ann", "other")]
    table = spark.createDataFrame(rows, SCHEMA)
    got = rotate(table)
    assert joined(got) == brute(rows)
    assert got.agg(F.max("n_turns"), F.sum("n_turns")).first() == (256, 2 * 6001 + 2)


def test_empty(spark):
    assert rotate(spark.createDataFrame([], SCHEMA)).count() == 0
