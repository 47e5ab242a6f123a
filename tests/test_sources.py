import json

import pytest
from pyspark.sql import functions as F

from sievework.functions import text as T
from sievework.operators import graph, quality, store, style, timestamps, units
from sievework.sources import connectors, postings, registry


def test_full_json_postings(spark, tmp_path):
    one = {"position": "Cook", "role": "x", "employer": "X", "pay": "$20 - $25 per hour", "applicants": "31", "seniority": "SENIOR", "job_type": "Full-Time", "sector": "Food", "employees": "11-50", "posted_by": "A B", "reposted": "yes", "listed_at": "2026-01-02", "wfh": True}
    (tmp_path / "a.json").write_text("\n".join(json.dumps(x) for x in (one, {"job_link": "u"})) + "\nnot json\n")
    (tmp_path / "b.json").write_text(json.dumps({"title": "Nurse", "place": "York"}, indent=1))
    (tmp_path / "c.json").write_text(json.dumps([{"name": "Clerk", "salary_min": 5, "salary": "$9"}], indent=1))
    (tmp_path / "d.json").write_text("")
    got = {r.title: r for r in postings.read_json(spark, str(tmp_path)).collect()}
    assert set(got) == {"Cook", "", "Nurse", "Clerk"} and got[""].url == "u" and got["Nurse"].location == "York" and got["Clerk"].salary_min == 5
    r = got["Cook"]
    assert (r.company, r.salary_min, r.salary_max, r.salary_currency, r.applicant_count, r.experience_level, r.employment_type, r.industry, r.company_size, r.recruiter_name, r.is_repost, r.is_remote, r.posted_date) == ("X", 20, 25, "USD", 31, "senior", "full-time", "Food", "11-50", "A B", True, True, "2026-01-02")


BOARDS = {
    "remoteok": [{"legal": "notice"}, {"position": "Cook", "url": "u", "company": "X", "description": "<p>Hi &amp; bye</p>", "salary_min": 10, "salary_max": "no", "date": "2026-01-01"}],
    "adzuna": {"results": [{"title": "Cook", "redirect_url": "u", "company": {"display_name": "X"}, "location": {"display_name": "York"}, "description": "Hi & bye", "created": "2026-01-01", "salary_min": 10}]},
    "themuse": {"results": [{"name": "Cook", "refs": {"landing_page": "u"}, "company": {"name": "X"}, "locations": [{"name": "York"}, {"name": "Leeds"}], "levels": [{"name": "Senior"}], "contents": "Hi & bye", "publication_date": "2026-01-01"}]},
    "usajobs": {"SearchResult": {"SearchResultItems": [{"MatchedObjectDescriptor": {"PositionTitle": "Cook", "PositionURI": "u", "OrganizationName": "X", "QualificationSummary": "Hi & bye", "PositionLocation": [{"LocationName": "York"}], "PositionRemuneration": [{"MinimumRange": "10", "MaximumRange": "20"}], "PublicationStartDate": "2026-01-01"}}]}},
    "remotive": {"jobs": [{"title": "Cook", "url": "u", "company_name": "X", "description": "Hi & bye", "category": "Food", "publication_date": "2026-01-01"}]},
    "greenhouse": {"jobs": [{"title": "Cook", "absolute_url": "u", "location": {"name": "York"}, "content": "Hi & bye", "updated_at": "2026-01-01"}]},
    "lever": [{"text": "Cook", "hostedUrl": "u", "categories": {"location": "York", "team": "Food"}, "description": "Hi & bye", "createdAt": 1767225600000}],
    "ashby": {"jobs": [{"title": "Cook", "jobUrl": "u", "location": "York", "descriptionHtml": "Hi <b>&amp;</b> bye", "publishedAt": "2026-01-01", "employmentType": "FullTime"}]},
    "smartrecruiters": {"content": [{"name": "Cook", "ref": "u", "location": {"city": "York", "country": "uk"}, "company": {"name": "X"}, "releasedDate": "2026-01-01"}]},
}


@pytest.mark.parametrize("board", sorted(connectors.BOARDS))
def test_boards(spark, tmp_path, board):
    (tmp_path / "one.json").write_text(json.dumps(BOARDS[board]))
    (tmp_path / "bad.json").write_text("<html>busy</html>")
    (row,) = registry.SOURCES[board](spark, str(tmp_path)).collect()
    assert (row.title, row.url, row.posted_date, row.source) == ("Cook", "u", "2026-01-01", board)
    assert row.description in ("Hi & bye", "") and row.company in ("X", "") and row.is_remote == (board in ("remoteok", "remotive"))
    assert row.location == {"themuse": "York, Leeds", "smartrecruiters": "York, uk", "remoteok": "Remote", "remotive": "Remote"}.get(board, "York")
    assert row.salary_min == (10 if board in ("remoteok", "adzuna", "usajobs") else 0)


def test_board_of_one_firm_and_search(spark):
    responses = spark.createDataFrame([(json.dumps(BOARDS["greenhouse"]),), (None,), ("",)], "value string")
    rows = connectors.from_responses(responses, "greenhouse", company=F.lit("Acme"))
    assert [r.company for r in rows.collect()] == ["Acme"]
    assert connectors.matching(rows, "cook bye", "york").count() == 1 and connectors.matching(rows, "cook nurse").count() == 0


def test_phrases_are_parted_as_texts_are(spark):
    df = spark.createDataFrame([(1, "Part-time work!"), (2, "work"), (3, "earn $5,000/week now"), (4, None)], "id int, t string")
    find = lambda p: [r.id for r in store.phrase_search(df, p, ["t"]).orderBy("id").collect()]
    assert find("part-time work") == [1] and find("$5,000/week") == [3] and find("  $ ") == []


def test_families_at_a_floating_point_edge(spark):
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(240)]
    a = words[:101]  # 100 pairs of words, 55 of them shared: similarity just at or above the bound for the longer prefix
    b = words[:101]
    df = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b[:78] + words[150:160])), (3, " ".join(words[100:150]))], "k int, t string")
    pairs = {(r.a, r.b) for r in style.families(df, "k", "t", 0.55).collect()}
    sets = {k: {tuple(x) for x in zip(w, w[1:])} for k, w in ((1, a), (2, b[:78] + words[150:160]), (3, words[100:150]))}
    assert pairs == {(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.55}


def test_components_that_do_not_settle_raise(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    with pytest.raises(RuntimeError):
        graph.components(chain, "a", "b", rounds=1)
    assert {r.component for r in graph.components(chain, "a", "b").collect()} == {0}


def test_long_digits_and_great_counts(spark):
    feeds = spark.createDataFrame([("s", "UTC", "DMY")], "source string, zone string, date_order string")
    values = ["1700000000", "1700000000000", "170000000000000", "9" * 40, "3 days ago", "123456789 weeks ago", "100000 days ago"]
    df = spark.createDataFrame(list(enumerate(values)), "id long, v string").withColumns({"source": F.lit("s"), "at": F.timestamp_seconds(F.lit(1_700_000_000))})
    got = {r.row_id: r.utc_us for r in timestamps.resolved(df, "id", "v", "source", feeds, "at").collect()}
    assert got == {0: 1_700_000_000_000_000, 1: 1_700_000_000_000_000, 2: None, 3: None, 4: 1_699_740_800_000_000, 5: None, 6: None}


def test_mixture_finds_planted_units(spark):
    rows = [(i, 50_000.0 + 400 * (i % 60), 0.0, "USD per year", None) for i in range(300)]
    rows += [(1000 + i, 20.0 + 0.2 * (i % 60), 0.0, "USD", None) for i in range(120)]  # by the hour, without a word
    rows += [(2000 + i, 52_000.0 + 300 * (i % 60), 0.0, "USD", "Far " * 60 + "away.") for i in range(200)]
    rows += [(3000, 30.0, 0.0, "USD", "The pay is, " + "as we said before, " * 40 + "in USD and " + "always " * 40 + "an hour.")]
    df = spark.createDataFrame(rows, "id long, a double, b double, u string, t string")
    got = {r.id: r for r in units.yearly(df, "id", "a", "b", "u", "t").collect()}
    assert all(got[1000 + i].unit == "hour" and not got[1000 + i].uncertain and got[1000 + i].year_min == round(rows[300 + i][1] * 2080) for i in range(120))
    assert all(got[2000 + i].unit == "year" for i in range(200)) and got[3000].year_min == 62_400
    sure = {r.id: (r.unit, r.posterior) for r in units.yearly(df, "id", "a", "b", "u", "t", prior={"year": 1.0}).collect()}
    assert sure[1000] == ("year", 1.0) and sure[3000] == ("hour", 1.0)


def test_chi_square_and_digits(spark):
    cells = spark.createDataFrame([("a", 10, 20), ("b", 30, 5), ("c", 0, 0)], "k string, x long, y long")
    row = quality.chi_square(cells, "x", "y").head()
    assert abs(row.chi_square - 65 * (10 * 5 - 20 * 30) ** 2 / (30 * 35 * 40 * 25)) < 1e-9 and row.freedom == 1  # the closed form of a 2 x 2 table
    assert quality.chi_square(cells.limit(0), "x", "y").head().chi_square is None


def test_unleet(spark):
    df = spark.createDataFrame([("p4ssw0rd",), ("2026",), ("$$$",), (None,), ("",)], "w string")
    assert [r[0] for r in df.select(T.unleet(F.col("w"))).collect()] == ["password", "2026", "$$$", None, ""]
