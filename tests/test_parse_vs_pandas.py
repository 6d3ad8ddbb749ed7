"""The numeric parse agrees with the reference's coercing parser (pandas
``to_numeric(errors='coerce')``) on generated number-like text."""

import random

import pandas as pd

from rentalytics.functions import numeric_text

TOKENS = ["0", "1", "7", "9", ".", "e", "E", "+", "-", " ", "\t", "\n", "inf", "INF", "Infinity", "nan",
          "NaN", "x", "d", ",", "_", "1e", "0x1", "1e500", "-inf"]


def test_numeric_text_matches_pandas(spark):
    rnd = random.Random(11)
    vals = sorted({"".join(rnd.choice(TOKENS) for _ in range(rnd.randint(0, 5))) for _ in range(6000)})
    got = {r.v: r.p for r in spark.createDataFrame([(v,) for v in vals], "v string")
           .select("v", numeric_text("v").alias("p")).collect()}
    expect = pd.to_numeric(pd.Series(vals, dtype=object), errors="coerce")
    diffs = []
    for v, e in zip(vals, expect):
        e = None if pd.isna(e) else float(e)
        if e != got[v]:
            diffs.append((v, e, got[v]))
    assert diffs == []


def test_price_text_matches_strip_then_float(spark):
    """Price text: keep digits and dots, then parse.  Where the reference's
    parse raises (no digits, two dots) ours is NULL; elsewhere they agree."""
    from rentalytics.functions import price_text

    rnd = random.Random(5)
    tokens = ["$", "€", ",", ".", " ", "0", "1", "5", "9", "00", "1,250", "-", "USD", "k"]
    vals = sorted({"".join(rnd.choice(tokens) for _ in range(rnd.randint(0, 6))) for _ in range(4000)})
    got = {r.v: r.p for r in spark.createDataFrame([(v,) for v in vals], "v string")
           .select("v", price_text("v").alias("p")).collect()}
    stripped = pd.Series(vals, dtype=object).str.replace(r"[^\d.]", "", regex=True)
    checked = 0
    for v, s in zip(vals, stripped):
        try:
            expect = float(s)
        except ValueError:
            assert got[v] is None
            continue
        assert got[v] == expect
        checked += 1
    assert checked > 1000


def test_amenity_list_matches_python_list_literals(spark):
    """Well-formed list literals parse like Python's literal parser; malformed
    text (which the reference rejects) gives an empty list."""
    import ast

    from rentalytics.functions import amenity_list

    forms = ['["Wifi", "Kitchen"]', "['Wifi', 'Kitchen']", "[]", '["a, b"]', '["Caf\\u00e9"]',
             '["say \\"hi\\""]', "['it\\'s']", '[ \'x\' , "y" ]', '["a",]', '["a", "b" , ]', '["x\\\\y"]',
             '["emoji 😀"]', '["line\\nbreak"]', "[1, 2]"]
    malformed = ['["a"] trailing', "junk", '["a"', "", "null"]
    got = {r.v: r.p for r in spark.createDataFrame([(f,) for f in forms + malformed], "v string")
           .select("v", amenity_list("v").alias("p")).collect()}
    for f in forms:
        assert got[f] == [str(x) for x in ast.literal_eval(f)], f
    for f in malformed:
        assert got[f] == [], f


def test_amenity_list_on_drawn_literals(spark):
    """Every token of the grammar, well-formed or not, against Python's own parser."""
    import ast
    import random
    import warnings

    from rentalytics.functions import amenity_list

    draw = random.Random(5)
    pieces = ["a", "Wi fi", "é", "日", "😀", ",", "[", "]", "#", " ", "\\n", "\\t", "\\\\", "\\'", '\\"', "\\x41", "\\xe9",
              "\\u2019", "\\U0001F600", "\\101", "\\7", "\\d", "\\/", "\\\n", "\\x4", "\\u12", "\\U00110000", "\\N{DASH}",
              "'", '"', "\n", "\x01", ";", ".", "r"]

    def string():
        quote = draw.choice(["'", '"', "'''", '"""'])
        return draw.choice(["", "", "", "r", "u", "R", "b", "f"]) + quote + "".join(draw.choices(pieces, k=draw.randrange(5))) + quote

    def literal():
        items = [draw.choice(["", " "]).join(string() for _ in range(draw.choice([1, 1, 1, 2]))) for _ in range(draw.randrange(4))]
        text = "[" + draw.choice([",", ", ", " ,\n"]).join(items) + draw.choice(["", "", ",", ", "]) + "]"
        return draw.choice(["", "", "", "x", "("]) + text.replace(" ", draw.choice([" ", " # c\n"]), 1) + draw.choice(["", "", "", "\n", "]"])

    def expected(text):
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            try:
                found = ast.literal_eval(text)
            except Exception:
                return []
        return found if isinstance(found, list) and all(isinstance(x, str) for x in found) else []

    texts = [literal() for _ in range(4000)]
    texts += ["[ ]", "[,]", "['a' 'b', 'c']", "['Caf\\xe9', 'TV']", "['Wi' 'fi']", "[" + ",".join(["'x\\n'"] * 20_000) + "]",
              "['" + "\\n" * 50_000 + "']"]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, v string").repartition(8)
    got = {r.i: r.items for r in frame.select("i", amenity_list("v").alias("items")).collect()}
    assert [t[:80] for i, t in enumerate(texts) if got[i] != expected(t)] == []
    assert sum(bool(expected(t)) for t in texts) > 300
    pair, half = spark.createDataFrame([('["\\ud83d\\ude00"]',), ('["\\ud83d"]',)], "v string").select(amenity_list("v")).collect()
    assert (pair[0], half[0]) == (["😀"], ["\ufffd"])
