"""Verdicts on cases: a fitting one, and one thing broken at a time."""

import pytest

from sedge.operators import quality

REOPEN = ("open the source", "digests say which")
EXPECTED = "case_id string, kind string, at int, text string, source string, line_start int, line_end int"
CARDS = "case_id string, at int, claim string, evidence string, flags array<string>, source string, sha256 string, trust_tier string, line_start int, line_end int"
LINES = "case_id string, place string, line string"
INPUTS = "case_id string, source string, sha256 string, bytes int, trust_tier string, lines int"
MANIFEST = "case_id string, at int, source string, sha256 string, bytes int, trust_tier string"


def case(name):
    """A case that meets all that is expected of it, as lists of rows that a test may change."""
    cards = [
        [name, 0, "must not deploy today", "must not deploy today", [], "a", "da", "t", 1, 2], [name, 1, "who owns it?", "who owns it?", [], "a", "da", "t", 3, 3],
        [name, 2, "token [REDACTED] here", "token [REDACTED] here", ["redacted"], "b", "db", "u", 1, 1], [name, 3, "plain words", "plain words", [], "a", "da", "t", 4, 4],
    ]
    places = ["critical", "question", "summary", "summary"]
    return {
        "expected": [
            [name, "constraints", 0, "must not", None, None, None], [name, "forbidden_constraints", 0, "plain", None, None, None], [name, "open_questions", 0, "who owns", None, None, None],
            [name, "redacted_claims", 0, "token [REDACTED]", None, None, None], [name, "forbidden_fragments", 0, "secret-1", None, None, None], [name, "clean_claims", 0, "plain words", None, None, None],
            [name, "clean_sources", 0, None, "a", None, None], [name, "claim_provenance", 0, "plain", "a", 4, 4],
        ],
        "cards": cards, "lines": [[name, p, f"- c{i} {c[2]}"] for i, (p, c) in enumerate(zip(places, cards, strict=True))] + [[name, "summary", f"- {x}."] for x in REOPEN],
        "inputs": [[name, "a", "da", 9, "t", 4], [name, "b", "db", 5, "u", 1]], "manifest": [[name, 0, "a", "da", 9, "t"], [name, 1, "b", "db", 5, "u"]],
    }


def put(table, row, column, value):
    def change(c):
        c[table][row][column] = value

    return change


def take(table, row):
    return lambda c: c[table].pop(row)


def also(table, row):
    return lambda c: c[table].append([c[table][0][0], *row])


def all_clean(c):
    c["expected"].append([c["expected"][0][0], "clean_sources", 1, None, "b", None, None])


BROKEN = {
    "fits": (lambda c: None, []),
    "constraint not in its section": (put("lines", 0, 1, "summary"), ["constraints.missing[0]"]),
    "constraint in no card": (put("cards", 0, 2, "other"), ["constraints.missing[0]"]),
    "forbidden constraint": (put("lines", 3, 1, "critical"), ["constraints.forbidden[0]"]),
    "question in no card": (put("cards", 1, 2, None), ["open_questions.missing[0]", "redaction.clean_source_violation[1]"]),
    "masked claim without its flag": (put("cards", 2, 4, []), ["redaction.required_claim_missing[0]"]),
    "masked claim not in the summary": (put("lines", 2, 1, "other"), ["redaction.required_claim_missing[0]"]),
    "fragment in the evidence": (put("cards", 2, 3, "is secret-1"), ["redaction.forbidden_fragment[0]"]),
    "fragment in the row encoding": (also("lines", ["other", "xsecret-1"]), ["redaction.forbidden_fragment[0]"]),
    "clean claim not in the summary": (take("lines", 3), ["redaction.clean_claim_missing[0]"]),
    "clean source flagged": (put("cards", 3, 4, ["redacted"]), ["redaction.clean_source_violation[3]"]),
    "clean source without flags": (put("cards", 3, 4, None), ["redaction.clean_source_violation[3]"]),
    "mask where all is clean": (all_clean, ["redaction.clean_artifact_violation", "redaction.clean_source_violation[2]"]),
    "binding of other lines": (put("expected", 7, 5, 3), ["provenance.claim_binding[0]"]),
    "binding of another source": (put("expected", 7, 4, "b"), ["provenance.claim_binding[0]"]),
    "two cards, one astray": (put("cards", 1, 2, "who owns it? plain"), ["provenance.claim_binding[0]"]),
    "manifest too short": (take("manifest", 1), ["provenance.manifest_input_count", "provenance.manifest_sources_incomplete"]),
    "manifest repeats": (put("manifest", 1, 2, "a"), ["provenance.manifest_source[1]", "provenance.manifest_sources_incomplete"]),
    "manifest does not know": (put("manifest", 1, 2, "z"), ["provenance.manifest_source[1]", "provenance.manifest_sources_incomplete"]),
    "manifest of another size": (put("manifest", 0, 4, 8), ["provenance.manifest_metadata[0]"]),
    "manifest without a tier": (put("manifest", 0, 5, None), ["provenance.manifest_metadata[0]"]),
    "card of an unknown source": (put("cards", 2, 5, "z"), ["provenance.card_source[2]", "provenance.card_sources_incomplete"]),
    "card of another digest": (put("cards", 2, 6, "x"), ["provenance.card_metadata[2]"]),
    "card beyond its source": (put("cards", 2, 9, 2), ["provenance.card_metadata[2]"]),
    "card from line 0": (put("cards", 2, 8, 0), ["provenance.card_metadata[2]"]),
    "no reopening": (take("lines", 5), ["provenance.source_reopen_instructions"]),
}


@pytest.fixture(scope="module")
def found(spark):
    all_of = {t: [] for t in ("expected", "cards", "lines", "inputs", "manifest")}
    for name, (change, _) in BROKEN.items():
        own = case(name)
        change(own)
        for t, rows in own.items():
            all_of[t] += [tuple(r) for r in rows]
    tables = [spark.createDataFrame(all_of[t], s) for t, s in (("expected", EXPECTED), ("cards", CARDS), ("lines", LINES), ("inputs", INPUTS), ("manifest", MANIFEST))]
    cases = spark.createDataFrame([(n,) for n in [*BROKEN, "nothing at all"]], "case_id string")
    return quality.verdicts(cases, *tables, REOPEN).cache()


def test_verdicts(found):
    got = {r.case_id: r for r in found.collect()}
    assert {n: got[n].failures for n in BROKEN} == {n: sorted(want) for n, (_, want) in BROKEN.items()}
    for name, r in got.items():
        assert r.passed == (not r.failures) and all(r[f"{d}_ok"] == (not any(quality_of(x) == d for x in r.failures)) for d in quality.DIMENSIONS), name
    bare = got["nothing at all"]
    assert bare.failures == ["provenance.source_reopen_instructions"] and not any(bare[f"{d}_applies"] for d in quality.DIMENSIONS)
    assert (got["fits"].sources, got["fits"].clean_sources, got["fits"].constraints_met, got["binding of other lines"].claim_provenance_met) == (2, 1, 1, 0)


def quality_of(code):
    return code.split(".")[0]


def test_report(spark, found):
    fits = found.where("case_id = 'fits'").selectExpr("*", "0 AS at")
    listed = lambda *rows: spark.createDataFrame(rows, "case_id string, at int")
    one = {r.dimension: r for r in quality.report(fits, listed(("fits", 0))).collect()}
    assert set(one) == {*quality.DIMENSIONS, "gate"} and all(r.ok and r.cases_total == r.cases_applicable == r.cases_passed == 1 for r in one.values())
    for other in ([("fits", 1)], [("fits", 0), ("more", 1)], [("less", 0)], [("fits", 0), ("fits", 0)]):
        gate = {r.dimension: r for r in quality.report(fits, listed(*other)).collect()}["gate"]
        assert not gate.in_order and not gate.ok
    two = found.where("case_id in ('fits', 'no reopening', 'nothing at all')").selectExpr("*", "length(case_id) AS at")
    got = {r.dimension: (r.cases_applicable, r.cases_passed, r.ok) for r in quality.report(two, two.select("case_id", "at")).collect()}
    assert got == {"constraints": (2, 2, True), "open_questions": (2, 2, True), "redaction": (2, 2, True), "provenance": (2, 1, False), "gate": (3, 1, False)}
    none = quality.report(fits.where("false"), listed(("fits", 0)).where("false")).collect()
    assert len(none) == 5 and not any(r.ok for r in none)


def test_pairs_are_no_rows(spark):
    """Expectations meet only the lines that hold them: the search is in the join, not behind it."""
    expected = spark.createDataFrame([(1, "constraints", 0, "ab", "s", 1, 1), (1, "forbidden_fragments", 1, "zz", "s", 1, 1), (2, "constraints", 0, None, "s", 1, 1)], "case_id int, kind string, at int, text string, source string, line_start int, line_end int")
    cards = spark.createDataFrame([(1, "xaby", "e", [], "s", 1, 1), (1, None, None, None, "s", 1, 1), (3, "ab", "zz", [], "s", 1, 1)], "case_id int, claim string, evidence string, flags array<string>, source string, line_start int, line_end int")
    lines = spark.createDataFrame([(1, "critical", "ab"), (1, "summary", "b"), (2, "summary", None)], "case_id int, place string, line string")
    found = quality.anchors(expected, cards, lines)
    assert sorted(map(tuple, found.collect())) == [(1, "constraints", 0, True), (1, "forbidden_fragments", 1, True), (2, "constraints", 0, False)]
    joins = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join LeftOuter" in x]
    assert len(joins) == 1 and "Contains(" in joins[0]
