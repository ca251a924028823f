import random
import unicodedata

import duckdb
import pytest
from pyspark.sql import functions as F

from cinderlog.functions import answers, masks
from cinderlog.functions import text as tx
from cinderlog.operators import parse
from cinderlog.plans import oracles

NORMAL = (
    "- 1700000001 2023.11.14 R10-M0-N1-C:J02-U01 2023-11-14-22.13.21.123456 "
    "R10-M0-N1-C:J02-U01 RAS KERNEL INFO opened /a/b9/c from 10.0.0.1:80"
)
ALERT = (
    "EVTFAIL 1700000002 2023.11.14 R10-M0-N1-C:J02-U01 2023-11-14-22.13.22.5 "
    "R10-M0-N1-C:J02-U01 RAS APP FATAL lost peer u-9: no answer"
)


def apply(spark, values, f, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
    return [r[1] for r in df.select("i", f(F.col("x"))).orderBy("i").collect()]


def test_mask_bgl_by_hand(spark):
    lines = [NORMAL, "abc: then x9", "abc: then xy", ":abc 1a", "at /a/b9/c", "at /", "a/b",
             "0x1f2e rest", "deadbeef01", "A" * 28, "aZ" * 24]
    got = [" ".join(s.split()) for s in apply(spark, lines, masks.mask_bgl)]
    assert got == [
        "- IAR NUM TIME SERVER TIME SERVER RAS KERNEL INFO opened PATH from IP",
        "SERVER then x NUM", "abc: then xy", ":abc NUM a", "at PATH", "at /", "a/b",
        "MEMORY rest", "IAR NUM", "ECID", "SERIAL",
    ]


def test_mask_bgl_equals_the_form_without_lookaround(spark):
    rng = random.Random(5)
    alphabet = "ab1F9 ::--//..  0x" + "Z"
    lines = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for _ in range(4000)]
    mine = apply(spark, lines, masks.mask_bgl)
    con = duckdb.connect()
    con.execute("CREATE TABLE src (i INT, line VARCHAR)")
    con.executemany("INSERT INTO src VALUES (?, ?)", list(enumerate(lines)))
    sql = oracles.ctes(*oracles.mask_bgl("src")) + "SELECT t FROM masked ORDER BY i"
    assert mine == [r[0] for r in con.execute(sql).fetchall()]


def test_ascii_and_general_masks_agree(spark):
    lines = [NORMAL, ALERT, "a:1 b-2c /x/y 0xabc:", "- x y/z1 -- a1-:b2"]
    plain = apply(spark, lines, masks.mask_bgl)
    general = apply(spark, [line + " é" for line in lines], masks.mask_bgl)
    assert [g.removesuffix(" é") for g in general] == plain


def test_unicode_digits_and_spaces(spark):
    assert apply(spark, ["٣٤ a b:1"], masks.mask_bgl) == [" NUM  a\u2003b: NUM "]
    assert apply(spark, ["x ٣٤"], masks.mask_bgl) == ["x  NUM "]
    assert apply(spark, ["a b \x1cc"], tx.tokens, "string") == [["a", "b", "c"]]


def test_hdfs_block_ids(spark):
    lines = ["got blk_5 x", "got blk_-5 x", "got blk_12 x"]
    assert apply(spark, lines, masks.first_block_id) == [None, "blk_-5", "blk_12"]
    assert apply(spark, lines, masks.mask_hdfs) == ["got blk_NUM x", "got BLK x", "got BLK x"]


def test_normalise(spark):
    values = ["Café ≮ naïve", "éa", "  A1b2 <x>\t", "", "日本 ok"]
    assert apply(spark, values, tx.normalise) == ["cafe < naive", "ea", "a b <x>", "", "ok"]


def test_normalise_equals_full_decomposition(spark):
    rng = random.Random(3)
    pool = [chr(c) for c in range(0xA0, 0x250)] + list("abC <>1̧́") + ["ﬁ", "≯", "Å"]
    values = ["".join(rng.choice(pool) for _ in range(20)) for _ in range(500)]

    def expected(s):
        s = unicodedata.normalize("NFD", s.strip().lower())
        s = "".join(c for c in s if unicodedata.category(c) != "Mn")
        kept = "".join(c if c in "<>" or (c.isascii() and c.isalpha()) else " " for c in s)
        return " ".join(kept.split())

    assert apply(spark, values, tx.normalise) == [expected(v) for v in values]


def test_preprocess_labels_rejects_and_text(spark):
    rows = [NORMAL, ALERT, "", "- 1 2 3", masks.HEADER_LINE.upper(), "a b c d e f g h i j",
            "- x 2024-13-45-00.00.00.0 y"]
    df = spark.createDataFrame(list(enumerate(rows)), "line_id int, line string")
    got = {r.line_id: r for r in parse.preprocess(df).collect()}
    assert got[0].label == 0 and got[1].label == 1
    assert got[0].sentence == "server time server ras kernel info opened path from ip"
    assert got[1].sentence.endswith("ras app fatal lost peer server no answer")
    assert str(got[1].ts) == "2023-11-14 22:13:22.500000"
    assert got[2].reject == "blank" and got[3].reject == "no_timestamp"
    assert 4 not in got and got[5].reject == "no_timestamp" and got[6].reject == "no_timestamp"
    assert parse.usable(parse.preprocess(df)).count() == 2


def test_label_comes_from_the_masked_first_token(spark):
    df = spark.createDataFrame(
        [(0, "-2023.01.02 a 2023-11-14-22.13.22.5 b")], "line_id int, line string"
    )
    assert parse.preprocess(df).first().label == 0
    assert parse.label_lines(df).first().label == 1


def test_parse_fields_needs_ten_tokens(spark):
    df = spark.createDataFrame(
        [(7, "  " + NORMAL), (8, "- 1 2 3"), (9, "")], "line_id int, line string"
    )
    rows = parse.parse_fields(df).collect()
    assert [r.line_id for r in rows] == [7]
    assert rows[0].log_text == (
        "TYPE=RAS COMPONENT=KERNEL LEVEL=INFO CONTENT=opened /a/b9/c from 10.0.0.1:80"
    )
    assert parse.drop_malformed(df, min_tokens=1).count() == 2


@pytest.mark.parametrize(
    "reply, strict, first, fallback, last",
    [
        ("0", 0, 0, 0, "0"),
        ("<think>maybe 0\n</think> so 1", 1, 1, 0, "1"),
        ("<think> open 1", 1, 1, 0, "1"),
        ("answer 1, not 0", 1, 1, 0, "0"),
        ("x10y", -1, 1, 1, "0"),
        ("none", -1, 0, 1, "0"),
        ("", -1, 0, 1, "0"),
    ],
)
def test_answers(spark, reply, strict, first, fallback, last):
    r = F.lit(reply)
    row = spark.range(1).select(
        answers.parse_strict(r), answers.parse_first(r), answers.used_fallback(r),
        answers.parse_last(r),
    ).first()
    assert tuple(row) == (strict, first, fallback, last)


@pytest.mark.parametrize(
    "reply, expected",
    [
        ('so {"Label": "1", "line": "a"} ok', ("1", "a")),
        ('{"Label": 0}', ("0", None)),
        ('{"Label": 1, bad}', ("1", "l")),
        ('{"label": 10}', ("0", "l")),
        ("nothing", ("1", "l")),
    ],
)
def test_json_answers(spark, reply, expected):
    row = spark.range(1).select(answers.parse_json_label(F.lit(reply), F.lit(" l "))).first()[0]
    assert tuple(row) == expected
