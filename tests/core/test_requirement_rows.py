"""Requirements of descriptions: sections, clauses, sentences, places and limits."""

import pytest

from millrace.functions import requirement_rows as rr


def found(text, title="Lead", screens=()):
    return [(r[1], r[3], r[4]) for r in rr.requirements(text, title, screens)]


REQ, PREF, CRED, OTHER = "REQUIRED EXPERIENCE", "PREFERRED EXPERIENCE", "ROLE-DEFINING QUALIFICATIONS", "OTHER"
CASES = {
    "Qualifications\n- CRM experience\n1. Travel\nSales Background\nNice to have:\n• Spanish": [("CRM experience", "required", REQ), ("Travel", "required", REQ), ("Sales Background", "required", REQ), ("Spanish", "preferred", PREF)],
    "REQUIREMENTS\nas many of the following as possible\nGerman": [("German", "preferred", PREF)],
    "Requirements:\nA degree is preferred. You must drive.": [("You must drive.", "required", OTHER)],
    "Requirements:\nA degree is not required": [("Primary core function of the Lead", "required", OTHER)],
    "Who you are\nKind\nBenefits & Perks\nKind people. At least 3 years of it! No fee is required": [("Kind", "required", REQ), ("At least 3 years of it!", "required", OTHER)],
    "Compensation\nYou must accept.\nRequirements\nEnglish": [("English", "required", REQ)],
    "Requirements\nsales, 3 years of retail, and valid driver's license, and customer relations; and proficiency in Excel, Word": [("sales", "required", REQ), ("3 years of retail", "required", REQ), ("valid driver's license", "required", REQ), ("customer relations", "required", REQ), ("proficiency in Excel, Word", "required", REQ)],
    "Role-defining qualification:\npreferred: a badge\nRequired verification item: A seal": [("preferred: a badge", "preferred", CRED), ("A seal", "required", CRED)],
    "Requirements\nEnglish.\n* english;\nNot stated\nWhat makes you stand out\n- Preferred Skills": [("English.", "required", REQ)],
    "": [("Primary core function of the Lead", "required", OTHER)],
    None: [("Primary core function of the Lead", "required", OTHER)],
}


@pytest.mark.parametrize("text", CASES)
def test_sections_and_clauses(text):
    assert found(text) == CASES[text]


def test_screens_see_the_whole_line():
    assert found("Requirements\nPay offered depends on skills, experience of all kinds", screens=[r"(?i)\bpay offered\b"]) == [("Primary core function of the Lead", "required", OTHER)]
    assert found(None, None) == [("Primary core function of the assigned role", "required", OTHER)]


def test_limits_name_the_fault():
    assert rr.requirements("Requirements\n" + "\n".join(f"thing {i}" for i in range(32)), "t")[-1][9] is None
    assert [r[9] for r in rr.requirements("Requirements\n" + "\n".join(f"thing {i}" for i in range(33)), "t")] == ["too_many"]
    assert [r[9] for r in rr.requirements("Requirements\n" + "x" * 501, "t")] == ["too_long"]


def test_places_are_those_of_code_points(spark):
    text = "😀 intro\n  You must drive.  Must  travel!\n\tRequirements\n   - 😀 skill \n"
    df = spark.createDataFrame([(1, text, "t"), (2, None, None)], "k long, d string, title string")
    made = rr.requirement_rows(df, "d", "title").where("k = 1").collect()
    assert [(r.text, text[r.start : r.end]) for r in made] == [("You must drive.", "You must drive."), ("Must travel!", "Must  travel!"), ("😀 skill", "- 😀 skill")]
    assert rr.requirement_rows(df.limit(0), "d", "title").count() == 0
    assert [r.source for r in rr.requirement_rows(df, "d", "title").where("k = 2").collect()] == ["core_function"]


def test_a_single_part_is_dealt_over_the_cores(spark):
    from pyspark.sql import functions as F

    df = spark.range(200).coalesce(1).select(F.col("id").alias("k"), F.concat(F.lit("Requirements\nskill "), F.col("id")).alias("d"), F.lit("t").alias("title"))
    made = rr.requirement_rows(df, "d", "title").select("text", F.spark_partition_id().alias("part")).collect()
    assert {r.text for r in made} == {f"skill {k}" for k in range(200)} and len({r.part for r in made}) >= 4
