"""Text functions on rows that the driver's tables never hold. Secrets are put together here, never written out."""

import hashlib
import unicodedata

import pytest
from pyspark.sql import functions as F

from sedge.functions import patterns as P
from sedge.functions import text as T
from sedge.functions import udfs
from sedge.functions import variants as V

AT = "@"
KEY = "sk-" + "a1B2" * 5


def one(spark, expression, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(expression.alias("x")).first().x


def redacted(spark, text):
    r = T.redact(spark.createDataFrame([(text,)], "text string")).first()
    return r.redacted, r.findings


def test_pattern_list_is_pinned():
    digest = hashlib.sha256("\n".join(s.name + s.pattern for s in P.SECRETS).encode()).hexdigest()
    assert len(P.SECRETS) == 9 and len(P.CONFUSABLE) == len(P.CONFUSED_WITH) == 45 and len(digest) == 64


@pytest.mark.parametrize(
    ("text", "masked", "found"),
    [
        (f"a {KEY} b", "a [REDACTED] b", ["pattern-1"]),
        ("ghp_" + "x" * 20, "[REDACTED]", ["pattern-2"]),
        ("AKIA" + "A1" * 8, "[REDACTED]", ["pattern-3"]),
        ("AIza" + "b" * 35, "[REDACTED]", ["pattern-4"]),
        ("eyJ" + "a" * 9 + "." + "b" * 9 + "." + "c" * 9, "[REDACTED]", ["pattern-5"]),
        ("x\n-----BEGIN PRIVATE KEY-----\nab\n-----END PRIVATE KEY-----\ny", "x\n[REDACTED]\n\n\ny", ["pattern-6"]),
        (f"token=a{AT}b.co and more", "[REDACTED] and more", ["pattern-7", "pattern-8"]),
        ("password:\n  hunter2hunter2 x", "[REDACTED]\n x", ["pattern-8"]),
        ("4111 1111 1111 1111 é", "[REDACTED]é", ["pattern-9"]),
        ("4111 1111 1111 1111.", "[REDACTED].", ["pattern-9"]),
        ("plain", "plain", []),
        ("", "", []),
        (None, None, []),
        (f"x{KEY}", f"x{KEY}", []),
        (f"e{chr(0x301)}{KEY}", unicodedata.normalize("NFKC", f"e{chr(0x301)}") + KEY, []),
        (f"s{chr(0x200B)}k-" + "a1B2" * 5, "[REDACTED]", ["pattern-1"]),
        (chr(0x455) + "k-" + "a1B2" * 5, "[REDACTED]", ["pattern-1"]),
    ],
)
def test_redaction(spark, text, masked, found):
    assert redacted(spark, text) == (masked, found)


def test_normalize(spark):
    text = "a\r\nb\rc" + chr(0x202E) + chr(0xE0041) + "\x07" + chr(0xFB01)
    assert T.normalize(spark.createDataFrame([(text,)], "text string")).first().normal == "a\nb\ncfi"
    assert one(spark, F.translate("t", P.CONFUSABLE, P.CONFUSED_WITH), t=P.CONFUSABLE) == P.CONFUSED_WITH


@pytest.mark.parametrize("text", ["", "a", "a\n", "a\n\nb", "\n", "a" + chr(0x85) + "b" + chr(0x2028)])
def test_lines_are_splitlines(spark, text):
    assert one(spark, T.lines("t"), t=text) == text.splitlines()


def test_claims(spark):
    assert one(spark, T.clean_claim(F.col("t")), t="  - ## 1. Do it. ") == "Do it."
    assert one(spark, T.clean_claim(F.col("t"), 10), t="abcdefgh ijkl") == "abcdefgh..."
    assert len(one(spark, T.card_claim(F.col("t")), t="must " + "x" * 500)) == 505
    assert one(spark, T.card_claim(F.col("t")), t="y" * 500) == "y" * 219 + "..."


def test_classes(spark):
    yes = {"is_critical": ["You MUST go", "ſource", "safe default"], "is_question": ["todo x", "what ?", "a unclear b"]}
    no = {"is_critical": ["musty", "xmust", "mustn"], "is_question": ["what?", "atodo"]}
    for f in yes:
        for text, want in [(t, True) for t in yes[f]] + [(t, False) for t in no[f]]:
            assert one(spark, getattr(T, f)(F.col("t")), t=text) is want, (f, text)


def test_defang(spark):
    assert one(spark, T.defang_claim(F.col("t")), t="![](u) ![a](u) [b](u) JavaScript:x https://h http://i `c`") == "[defanged-image: unnamed] [defanged-image: a] b [defanged-link] javascript-defanged:x hxxps://h hxxp://i `c`"
    assert one(spark, T.defang(F.col("t")), t="`c`") == "'c'"
    assert one(spark, T.claim_span(F.col("t")), t="a ``b`` `c`") == "``` a ``b`` `c` ```"
    assert one(spark, T.claim_span(F.col("t")), t="a") == "` a `"


@pytest.mark.parametrize(("text", "n"), [("", 0), ("a b", 2), ("a_1-b.", 4), ("éa", 2), ("\x1c\u3000a", 1)])
def test_tokens(spark, text, n):
    assert one(spark, T.token_count("t"), t=text) == n


@pytest.mark.parametrize(("value", "want"), [(None, "null"), ("", '""'), ("a b", "a b"), (" a", '" a"'), ("a\tb", '"a\\tb"'), ("True", '"True"'), ('q"', '"q\\""'), ("b\\", '"b\\\\"'), ("k:v", '"k:v"')])
def test_toon_field(spark, value, want):
    assert one(spark, T.toon_field(F.col("t")), t=value) == want


def test_keys_and_labels(spark):
    assert one(spark, T.slug(F.col("t")), t=" Ａb  c! ") == "ab-c"
    assert one(spark, T.slug(F.col("t")), t="é") is None
    assert one(spark, T.slug(F.col("t")), t="!") is None
    assert one(spark, T.custody_label(F.col("t")), t="\t In_House ") == "in-house"
    assert one(spark, T.joined_key(F.col("t"), F.lit("b"), size=8), t="a") == hashlib.sha256(b"a\nb").hexdigest()[:8]
    assert one(spark, T.row_set_name(F.col("t")), t="$.a[0]") == "a_0"
    assert one(spark, T.row_set_name(F.col("t")), t="$") == "rows"


def test_json_functions(spark):
    assert one(spark, udfs.canonical_json("t"), t='{"b": 1e10, "a": [true, null, "é"]}') == '{"a":[true,null,"é"],"b":10000000000.0}'
    assert one(spark, udfs.strict_json("t"), t='{"a": {"b": 1, "b": 2}}') is None
    assert one(spark, udfs.strict_json("t"), t="NaN") is None
    assert one(spark, udfs.extract_text("t"), t='{"output": ["a", {"text": "b"}], "x": "c"}') == "a\nb"
    sets = one(spark, udfs.row_sets("t"), t='{"a": [{"x": 1, "y": "s"}, {"x": 2.5, "y": null}], "b": [{"x": 1}, {"y": 2}]}')
    assert [(s.path, s.columns, s.rows, s.n) for s in sets] == [("$.a", ["x", "y"], [["1", "s"], ["2.5", None]], 2)]
    assert one(spark, udfs.round4(F.col("t").cast("double")), t="0.00005") == round(0.00005, 4)


def test_json_variant(spark):
    values = {"{}": "{}", " [1] ": "[1]", "5": "5", '"x"': '"x"', "null": "null", "{} {}": None, "{},{}": None, "{}],[{}": None, "1],[1": None, "": None, "NaN": None, '{"a":1,"a":2}': None, "{": None, "1 2": None, '{"a":[1,{"b":"]"}]}': '{"a":[1,{"b":"]"}]}'}
    df = spark.createDataFrame([(k, v) for k, v in values.items()] + [(None, None)], "t string, want string")
    got = df.select("t", "want", F.to_json(V.json_variant("t")).alias("got")).collect()
    assert [(r.t, r.got) for r in got] == [(r.t, r.want) for r in got]


def test_patterns_find_what_their_plain_forms_find(spark):
    """Patterns try cheap things first; the plain forms say what they must find, over pieces of words, edges and odd letters."""
    import random

    from pyspark.sql import functions as F

    from sedge.functions import patterns as P

    edge = rf"(?:(?<={P.WORD})(?!{P.WORD})|(?<!{P.WORD})(?={P.WORD}))"
    start = rf"(?<![A-Za-z0-9_])(?<!{P.WORD})"
    plain = {
        "critical": (P.CRITICAL, rf"(?iu){start}(?:{'|'.join(P.CRITICAL_WORDS)}){P.END}"), "question": (P.QUESTION, rf"(?iu)(?:^|{P.SPACE})(?:{'|'.join(P.QUESTION_WORDS)})"),
        "injection": (P.INJECTION, rf"(?iu){start}(?:{'|'.join(P.INJECTION_WORDS)}){edge}"), "control": (P.CONTROL, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"),
        "hidden": (P.HIDDEN, f"{P.ZERO_WIDTH}|{P.BIDI}|{P.TAG}"), "token": (P.TOKEN, rf"[A-Za-z0-9_]+|[^A-Za-z0-9_{P.SPACE_SET}]"),
        "mail": (P.SECRETS[6].pattern, rf"{edge}[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}{edge}"),
        "named": (P.SECRETS[7].pattern, rf"(?iu){start}(api[_-]?key|token|password|secret){P.SPACE}*[:=]{P.SPACE}*['\"]?[^'\"{P.SPACE_SET}]{{8,}}"),
    }
    rng = random.Random(5)
    words = [*P.CRITICAL_WORDS, *(w.replace("\\", "") for w in P.QUESTION_WORDS), "ſcope", "ſystem:", "ıgnore previous", "İgnore previous", "toKen", "api_key", "API-Key", "password", "SECRET", "base64", "curl http", "user:", "send to", "ab@c.de", "é@x.yz", "1234567890"]
    marks = [" ", " ", " ", "\n", "é", "_", "9", "x", "-", "=", ": ", ":", "@", "​", "‮", "\U000e0041", "\x01", "\x0b", "'", "а", "́", "😀", " ", "["]
    texts = ["".join(rng.choice([w := rng.choice(words), w.upper(), w.title(), rng.choice(marks), rng.choice(marks)]) for _ in range(rng.randint(1, 7))) for _ in range(4000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for name, (own, want) in plain.items():
        mark = lambda p: F.regexp_replace("t", p, "<>")
        hits = rows.where(F.col("t").rlike(want)).count()
        assert hits > 5, name
        wrong = rows.where(F.col("t").rlike(own) != F.col("t").rlike(want)) if name == "question" else rows.where(mark(own) != mark(want))
        assert wrong.count() == 0, (name, wrong.first())


def test_a_card_is_spanned_once(spark):
    """A claim's span was worked out where only references were read, and its fence worked the claim out again."""
    from sedge.operators import render

    cards = spark.createDataFrame([("r", 1, "c1@s1/a", "must I? [a](b) ``x`` data:y", 1, 2, ["f"], "t"), ("r", 2, "c2@s1/b", "plain", 3, 3, [], "t")], "run_id string, _ord long, ref string, claim string, line_start int, line_end int, flags array<string>, trust_tier string")
    rows = render.section_rows(cards)
    assert {(r.section, r.ord, r.line) for r in rows.collect()} == {
        ("1-claims", 1, "- c1@s1/a L1-2: ``` must I? a [defanged-link] ``x`` data-defanged:y ```"), ("2-critical-constraints", 1, "- c1@s1/a [t] [f]"), ("1-claims", 2, "- c2@s1/b L3-3: ` plain `"), ("4-findings", 2, "- c2@s1/b [t]"),
    }
    counted = rows.groupBy("run_id", "section").count()._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in counted


def test_what_arrow_lets_through_is_all_that_the_patterns_match(spark):
    words = [w.replace("\\", "").replace(P.SPACE + "+", "　") for w in (*P.CRITICAL_WORDS, *P.QUESTION_WORDS, *P.INJECTION_WORDS)]
    odd = [w.translate(str.maketrans(x)) for w in words for x in ({"s": "ſ", "k": "K", "i": "İ"}, {"i": "ı", "s": "S"})]
    texts = [f"{a}{w}{b}" for w in (*words, *odd) for a in ("", "é", "x", "_", " ", " ", "-") for b in ("", "é", "x", "_", ".", " ")]
    docs = spark.createDataFrame([([], 0), (None, 1), *[(texts[i : i + 7], 2) for i in range(0, len(texts), 7)]], "l array<string>, n int")
    assert [r.m for r in udfs.marked(docs.where("n < 2"), "l", "m").orderBy("n").collect()] == [[], None]
    rows = udfs.marked(docs, "l", "m").select(F.explode(F.arrays_zip("l", "m")).alias("x")).select("x.l", "x.m")
    found = rows.select("l", T.may_anchor(F.col("m")).alias("a"), T.is_anchor(F.col("l")).alias("b"), T.may_inject(F.col("m")).alias("c"), F.col("l").rlike(P.INJECTION).alias("d")).collect()
    assert len(found) == len(texts) and sum(r.b for r in found) > 100 and sum(r.d for r in found) > 50
    assert not [r.l for r in found if (r.b and not r.a) or (r.d and not r.c)]
    assert sum(not r.a for r in found) > 100  # and it does hold back


def test_cards_of_lines_are_marked_over_lines_and_formats_work_them_out_once(spark):
    from sedge.operators import analyze, cards

    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def once(t):
        seen.add(1)
        return t

    text = "no curl\nhttp://x.y ſend to\nit MUST be\nplain"
    docs = spark.createDataFrame([(1, text, [])], "doc_id long, redacted string, findings array<string>").withColumn("redacted", once("redacted"))
    docs = docs.withColumns({"run_id": F.lit("r"), "source": F.lit("s"), "trust_tier": F.lit("t"), "sha256": F.lit("0")})
    got = cards.cards(docs)
    assert [(r.claim, r.flags) for r in got.orderBy("card_rank").collect()] == [("it MUST be", ["injection-shaped", "has-url"]), ("http://x.y ſend to", ["injection-shaped", "has-url"])]
    before = seen.value
    assert analyze.choose_card_format(got).count() == 1 and seen.value == before + 1


def test_tokens_are_counted_without_making_them(spark):
    texts = ["", " ", "a", "ab_9 c", "é", "aé b", "ñ٣,\U0001f600\U0001f600 ", "\x85　a\x1f b", "a\nb\r\n\n", "--a--", "_", "'it''s'"]
    got = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", T.token_count("t").alias("n"), F.regexp_count("t", F.lit(P.TOKEN)).alias("m")).collect()
    assert all(r.n == (r.m or 0) for r in got) and sum(r.n for r in got) > 20
