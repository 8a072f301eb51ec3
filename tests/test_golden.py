"""Golden cases for the scalar kernels (FIXTURES.md §3)."""

from pyspark.sql import functions as F

from sagerow.config import EOS_TOKEN, SEP_TOKEN
from sagerow.functions import arrays as ar
from sagerow.functions import moses as mo
from sagerow.functions import text as tx
from sagerow.plans.tasks import WORD_TOKENS
from sagerow.sources.tasks import parse_task_lines


def one(spark, expr, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


def test_task_lines_src1(spark):
    lines = ["a||b", "", "   ", "x||y||z", "a||b||", "g||h"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lines)], "line_no long, value string")
    got = [(r.src, r.tgt_text, r.task_id) for r in parse_task_lines(df).orderBy("task_id").collect()]
    assert got == [("a", "b", 0), ("g", "h", 1)]


def test_split_gsm8k(spark):
    assert one(spark, tx.split_gsm8k_target(F.col("x")), "<<45-40=5>> <<400+60=460>> #### 460") == [
        " <<45-40=5>>", " <<400+60=460>> #### 460"]
    assert one(spark, tx.split_gsm8k_target(F.col("x")), "a b") == [" a b"]


def test_split_mult(spark):
    assert one(spark, tx.split_mult_target(F.col("x")), "50 + 200 #### 250") == ["50 + ", "200 = ", "250"]


def test_extract_gsm8k(spark):
    f = tx.extract_gsm8k_answer(F.col("x"))
    assert one(spark, f, "q" + SEP_TOKEN + " 1,234 " + EOS_TOKEN + "junk") == "1234"
    assert one(spark, f, "q" + SEP_TOKEN + " x #### 1,000" + EOS_TOKEN + "#### 7") == "1000"
    assert one(spark, f, "a #### b #### c") == "b #### c"


def test_extract_mult(spark):
    assert one(spark, tx.extract_mult_answer(F.col("x")), "q" + SEP_TOKEN + " 5 0 + 2 0 = 7 0 +" + EOS_TOKEN) == "7 0"


def test_parse_score(spark):
    texts = ["judge: 8", "judge: 7", "judge: 8/10", "judge: nan", "judge: 5d", "Quality (1-10):"]
    df = spark.createDataFrame([(t,) for t in texts], "x string").select(tx.parse_score("x").alias("s"))
    assert [r.s for r in df.collect()] == [8.0, 7.0, None, None, None, None]


def test_parse_generation(spark):
    f = tx.parse_generation(F.col("x"))
    r = one(spark, f, "T\n\nQuestion: q\nAnswer: a")
    assert (r.question, r.answer) == ("T\n\n q", "a")
    assert one(spark, f, "Answer: a Answer: b").question == ""
    assert one(spark, f, "no marker").answer == ""


def test_digit_and_byte_level(spark):
    assert one(spark, tx.digit_chunks(F.col("x")), "This is 1+11=12") == ["This is ", "1", "+", "1", "1", "=", "1", "2"]
    assert one(spark, tx.byte_level_pieces(F.col("x")), "This is 1+11=12") == ["This", " is", " 1", "+", "11", "=", "12"]


def test_normalizer_en(spark):
    df = spark.createDataFrame([("“Hi”, he said – ok…", "en")], "t string, lang string")
    assert mo.normalize_punctuation(df, "t", "lang", "n").first()["n"] == '"Hi," he said -- ok... '


def test_tokenizer(spark):
    cases = [
        ("Mr. Smith's dog, wait...", "Mr. Smith 's dog , wait ..."),
        ("a,b,c", "a , b,c"),
        ("No. 5 is 5,300.", "No. 5 is 5,300 ."),
    ]
    df = spark.createDataFrame([(a, "en") for a, _ in cases], "t string, lang string")
    got = [r.tok for r in df.select(mo.tokenize_words("t", "lang").alias("tok")).collect()]
    assert got == [b for _, b in cases]


def test_tokenizer_passthrough_and_french(spark):
    df = spark.createDataFrame([("<p>\nL'amour d'un. Fin\n  ", "fr")], "t string, lang string")
    assert df.select(mo.tokenize_words("t", "lang").alias("k")).first().k == "<p>\nL' amour d' un . Fin\n  "


def test_truncate_pair(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5], [9, 9])], "s array<int>, t array<int>")
    r = df.select(ar.truncate_pair("s", "t", 4).alias("p")).first().p
    assert (r.src_ids, r.tgt_ids) == ([4, 5], [9, 9])


def test_shift_sep_to_pad(spark):
    tk = WORD_TOKENS
    df = spark.createDataFrame([([7, tk.sep_id, 8, tk.pad_id, tk.pad_id],)], "x array<int>")
    r = df.select(ar.shift_sep_to_pad("x", 5, tk).alias("s")).first().s
    assert r.ids == [7, 8, tk.sep_id, tk.pad_id, tk.pad_id]
    assert r.mask == [True, True, True, False, False]


def test_sft_labels(spark):
    tk = WORD_TOKENS
    df = spark.createDataFrame([([5, 6, 7, 8],)], "x array<int>")
    r = df.select(ar.sft_labels("x", F.lit(2), 5, tk).alias("s")).first().s
    assert r.labels == [-100, -100, 7, 8, tk.pad_id]
    assert r.attention_mask == [1, 1, 1, 1, 0]


def test_bucket_of(spark):
    from sagerow.operators.analytics import bucket_of

    df = spark.createDataFrame([(i,) for i in range(6)], "step long")
    assert [r.b for r in df.select(bucket_of("step", 3).alias("b")).orderBy("step").collect()] == [0, 1, 1, 2, 2, 2]


def test_nfc_trigger_class_covers_every_change(spark):
    import random
    import re
    import unicodedata

    cls = mo.nfc_trigger_class()
    first = int(re.search(r"x\{([0-9A-F]+)\}", cls).group(1), 16)
    assert first >= mo.NFC_SAFE_BELOW
    # Python's re understands the same \x{...} ranges once rewritten
    py = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m.group(1), 16)).replace("\\", "\\\\").replace("]", "\\]").replace("-", "\\-").replace("^", "\\^"), cls))
    rnd = random.Random(2)
    pool = [chr(c) for c in list(range(0x20, 0x250)) + list(range(0x300, 0x370)) + [0x2126, 0x212B, 0x1100, 0x1161, 0x11A8, 0xAC00, 0xF900, 0x0CC6, 0x0CC2, 0x0CD5, 0x0B47, 0x0B3E, 0x0344, 0x0F73]]
    for _ in range(20000):
        s = "".join(rnd.choice(pool) for _ in range(rnd.randint(1, 6)))
        if unicodedata.normalize("NFC", s) != s:
            assert py.search(s), repr(s)
    df = spark.createDataFrame([(0, "e\u0301"), (1, "caf\u00e9"), (2, "\u212b"), (3, "plain"), (4, None)], "i int, t string").withColumn("l", F.lit("en"))
    got = {r.i: r.normalized for r in mo.normalize_punctuation(df, "t", "l").collect()}
    assert got == {0: "\u00e9", 1: "caf\u00e9", 2: "\u00c5", 3: "plain", 4: None}
