import pytest
from pyspark.sql import functions as F

from lexweave.functions import phonology as ph
from lexweave.functions import text as tx


def made(spark, f, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[1] for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


CASES = {
    "pha": "pʰa", "tsha": "t͡sʰa", "thing": "tʰiŋ", "ḷa": "ɭa", "t̤a": "t̤a", "áá": "aː", "aaa": "aːa", "anya": "anja", "y": "y", "ya": "ja",
    "tya": "tja", "byt": "byt", "ky": "ky", "ay": "aj", "yk": "yk", "ga³¹": "ɡa", "t͡sha ts": "t͡sʰa ts", "ña": "ɲa", "ǖ": "ü", "": "", "gɣ": "ɡɣ",
}


def test_normalized(spark):
    assert made(spark, tx.normalized, *CASES) == list(CASES.values())
    assert made(spark, tx.normalized, None) == [None]


def test_morphemes(spark):
    forms = ["a-b c", "--a", "x", "", None, "a  b"]
    assert made(spark, lambda c: tx.morpheme(c, F.lit(1)), *forms) == ["b", "--a", "x", "", None, "b"]
    assert made(spark, lambda c: F.size(tx.raw_morphs(c)), "a  b") == [3]
    assert made(spark, lambda c: tx.strong(c, F.lit(1)), "a-b c", "a", "", None) == ["a-<strong>b</strong> c", "a", "", ""]


def test_segments(spark):
    assert made(spark, tx.segment_text, "t͡sʰaːŋ1", "") == ["t͡sʰ aː ŋ", ""]


def test_distance():
    assert ph.distance("p", "p") == 0 and ph.distance("v", "w") == 0
    assert 0 < ph.distance("p", "b") <= 2 < 4 <= ph.distance("p", "a")
    assert ph.distance("p", "?") == ph.UNKNOWN_COST
    assert ph.distance("p", "t") == ph.distance("t", "p")
    assert dict(ph.features("t͡s"))["delrel"] == 1 and dict(ph.features("aː"))["long"] == 1 and dict(ph.features("tʰ"))["sg"] == 1


@pytest.mark.parametrize("word, parts", [("pata", "pa-ta"), ("pan", "pan"), ("anta", "an-ta"), ("st", "s-t"), ("", "")])
def test_syllables(word, parts):
    assert "-".join(ph.syllables(list(word))) == parts


def test_parse_syllable():
    assert ph.parse_syllable(list("tran")) == ("tr", "a", "n")
    assert ph.parse_syllable([]) == ("", "", "")


def test_inventory():
    from lexweave.functions import phonology as ph
    from lexweave.functions import text as tx

    assert all(ph.features(c) is not None for c in ph.inventory()) and {*"aptgßéñçɒʔ"} <= {*ph.inventory()} and not {*"AцʰʼͰ"} & {*ph.inventory()}
    assert all(ph.is_vowel(c) for c in tx.VOWELS) and {*"aeiouyéüɒʉ"} <= {*tx.VOWELS} and not {*"ptnjwgц"} & {*tx.VOWELS}
    assert ph.is_consonant("p") and ph.is_consonant("ц") and not ph.is_consonant("a") and not ph.is_consonant("1")
