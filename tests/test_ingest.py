"""Hand-made frames for the document structuring rules (PRS-1..7, SRC-2)."""

from pyspark.sql import functions as F

from talentscope import schemas as S
from talentscope.functions.text import js_trim, normalize_query, token_estimate
from talentscope.operators import ingest as I


def parse(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, content string")
    out = I.validation_errors(I.structure(df, "content", keep=["id"]))
    return {r["id"]: r for r in out.collect()}


def test_blank_text_and_unknown_name(spark):
    r = parse(spark, ["", "  \n\t\n"])
    for row in r.values():
        assert row["lines"] == []
        assert row["name"] == S.UNKNOWN_NAME
        assert row["email"] == ""
        assert row["phone"] is None
        assert row["errors"] == [S.ERR_NAME, S.ERR_EMAIL, S.ERR_SKILLS, S.ERR_EXPERIENCE]


def test_lines_kept_untrimmed_blank_dropped_cr_stays(spark):
    r = parse(spark, ["  Jane Doe  \r\n\r\n  \nsecond"])[0]
    assert r["lines"] == ["  Jane Doe  \r", "second"]
    assert r["name"] == "  Jane Doe  \r"


def test_repeated_heading_clears_section(spark):
    text = "Ann\nSKILLS\njava, sql\nSummary\nhello  \nskills: again\npython | go ;\n"
    r = parse(spark, [text])[0]
    assert r["skills"] == ["python", "go"]
    assert r["summary"] == "hello"


def test_keyword_inside_body_line_is_a_heading_and_order_matters(spark):
    text = "Bob\nSkills\na,b\nI have experience with skills\nx\n"
    r = parse(spark, [text])[0]
    # the body line holds both EXPERIENCE and SKILLS: EXPERIENCE is tested first
    assert r["experience_lines"] == ["x"]
    assert r["skills"] == ["a", "b"]


def test_lines_before_any_heading_dropped_and_empty_sections(spark):
    text = "Cy\nfree text\nSUMMARY\nEDUCATION\nSKILLS\n , ;|\n"
    r = parse(spark, [text])[0]
    assert r["summary"] == ""          # present but empty
    assert r["education_lines"] == []
    assert r["skills"] == []
    assert r["experience_lines"] is None


def test_email_and_phone_first_match(spark):
    text = "Dee\ncall +1 (555) 123-4567 or 555.987.6543\nmail a.b@x.io, c@d.org\n"
    r = parse(spark, [text])[0]
    assert r["email"] == "a.b@x.io"
    assert r["phone"] == "+1 (555) 123-4567"


def test_phone_does_not_cross_lines(spark):
    r = parse(spark, ["Eve\n555\n123 4567\n"])[0]
    assert r["phone"] is None


def test_validation_accepts_full_record_and_as_written_always_fails(spark):
    text = "Fay\nfay@x.org\nSkills\nsql\nExperience\ndev at co\n"
    df = spark.createDataFrame([(0, text)], "id long, content string")
    parsed = I.structure(df, "content", keep=["id"])
    ok = I.validation_errors(parsed).collect()[0]
    assert ok["accepted"] and ok["errors"] == []
    written = I.validation_errors(parsed, as_written=True).collect()[0]
    assert written["errors"] == [S.ERR_EXPERIENCE]


def test_js_trim_and_query_normalisation(spark):
    df = spark.createDataFrame([("\t  X y　 ",)], "q string")
    r = df.select(js_trim(F.col("q")).alias("t"), normalize_query(F.col("q")).alias("n"),
                  F.trim("q").alias("spark_trim")).collect()[0]
    assert r["t"] == "X y"
    assert r["n"] == "x y"
    assert r["spark_trim"] != r["t"]


def test_token_estimate_counts_utf16_units(spark):
    df = spark.createDataFrame([("abcd",), ("abcde",), ("\U0001F600",)], "s string")
    assert [r[0] for r in df.select(token_estimate(F.col("s"))).collect()] == [1, 2, 1]


def test_upload_gate_first_failed_check(spark):
    rows = [(0, None, 1), (1, "a.pdf", S.MAX_UPLOAD_BYTES + 1), (2, "a.exe", 5),
            (3, "a.PDF", 5), (4, "b.docx", S.MAX_UPLOAD_BYTES)]
    df = spark.createDataFrame(rows, "id long, file_name string, size_bytes long")
    out = {r["id"]: r for r in I.upload_gate(df).collect()}
    assert out[0]["reason"] == S.UPLOAD_ERR_MISSING
    assert out[1]["reason"] == S.UPLOAD_ERR_SIZE
    assert out[2]["reason"] == S.UPLOAD_ERR_TYPE
    assert out[3]["accepted"] and out[4]["accepted"]


def test_pipeline_gates_then_parses_then_routes(spark):
    good = "Ann Lee\nann@x.org\nSKILLS\njava, sql\nEXPERIENCE\nengineer at acme"
    no_skills = "Bob Roe\nbob@x.org\nEXPERIENCE\nclerk"
    uploads = spark.createDataFrame(
        [(1, "a.pdf", 100), (2, "b.txt", 100), (3, "c.exe", 100), (4, "d.docx", 11 * 1024 * 1024),
         (5, None, 10)], "id long, file_name string, size_bytes long")
    docs = spark.createDataFrame(
        [(1, 7, good), (2, 8, no_skills), (3, 9, good), (4, 9, good), (5, 9, good)],
        "id long, created_by long, content string")
    out = {r["id"]: r for r in I.ingest_pipeline(uploads, docs).collect()}
    assert out[1]["status"] == "accepted" and out[1]["reason"] is None
    assert out[1]["created_at"] is not None and out[1]["content"] == good
    assert out[2]["status"] == "quarantined" and out[2]["reason"] == S.ERR_SKILLS
    assert out[2]["created_at"] is None
    assert (out[3]["status"], out[3]["reason"]) == ("rejected", S.UPLOAD_ERR_TYPE)
    assert (out[4]["status"], out[4]["reason"]) == ("rejected", S.UPLOAD_ERR_SIZE)
    assert (out[5]["status"], out[5]["reason"]) == ("rejected", S.UPLOAD_ERR_MISSING)
    assert all(out[i]["parsed_data"] is None and out[i]["created_by"] == 9 for i in (3, 4, 5))


def test_every_upload_gives_one_row_and_the_record_can_be_read(spark):
    from pyspark.sql import functions as F

    from talentscope import schemas as S
    from talentscope.operators import ingest as I

    text = "Ann\na@x.io\nSkills\njava, sql\nExperience\ndev at co\nEducation\nBSc\n"
    uploads = spark.createDataFrame(
        [(1, "a.exe", 10), (2, "b.txt", 10), (3, "c.txt", 10), (4, None, 10), (5, "d.pdf", 11 << 20)],
        "id long, file_name string, size_bytes long")
    docs = spark.createDataFrame([(2, 7, text), (3, 8, None)], "id long, created_by long, content string")
    out = {r["id"]: r for r in I.ingest_pipeline(uploads, docs).collect()}
    assert {k: (r["status"], r["reason"]) for k, r in out.items()} == {
        1: ("rejected", S.UPLOAD_ERR_TYPE), 2: ("accepted", None), 3: ("quarantined", S.ERR_NO_TEXT),
        4: ("rejected", S.UPLOAD_ERR_MISSING), 5: ("rejected", S.UPLOAD_ERR_SIZE)}
    row = spark.createDataFrame([(out[2]["parsed_data"],)], "j string").select(
        F.from_json("j", S.PARSED_DOCUMENT).alias("p")).first()["p"]
    assert row["experience"][0]["description"] == "dev at co"
    assert row["education"][0]["institution"] == "BSc"
    assert row["skills"] == ["java", "sql"]
