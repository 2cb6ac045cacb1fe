from pyspark.sql import functions as F

from modsplit_spark.functions import identifiers as I

WORKED = {
    "parseXMLFile": ["parse", "xml", "file"], "HTTP2": ["http2"], "HTTPServer": ["http", "server"], "getAURL": ["get", "aurl"], "foo12": ["foo", "12"],
    "v2": ["v2"], "aB1": ["ab1"], "URLs": ["ur", "ls"], "__init__": ["init"], "<init>": ["<init>"], "": [], "getX": ["get", "x"],
}


def test_worked_values(spark):
    rows = spark.createDataFrame([(n,) for n in WORKED], "name string").select("name", I.split_identifier(F.col("name")).alias("t")).collect()
    assert {r["name"]: r["t"] for r in rows} == WORKED


def test_stems():
    # Examples of the 1980 paper, and words worked by hand from the later rules.
    for word, stem in {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "relational": "relat",
                       "conditional": "condit", "digitizer": "digit", "triplicate": "triplic", "hopeful": "hope", "revival": "reviv", "adoption": "adopt", "effective": "effect", "probate": "probat", "controll": "control",
                       "display": "display", "array": "array", "key": "key", "delay": "delay", "dies": "die", "died": "die", "cried": "cri", "possibly": "possibl", "apology": "apolog", "geology": "geolog", "theology": "theolog",
                       "hopefully": "hope", "nationally": "nation", "skies": "sky", "sky": "sky", "dying": "die", "news": "news", "innings": "inning", "succeed": "succeed", "proceed": "proceed", "is": "is", "by": "by", "owed": "owe"}.items():
        assert I.porter(word) == stem, word
    assert I.porter("y" * 20_000) and I.porter("") == ""


def test_termize_and_bigrams(spark):
    names = spark.createDataFrame([("p", "e1", "parsingFiles"), ("p", "e2", ""), ("p", "e3", None)], "parent_id string, entity_id string, name string")
    got = {r["entity_id"]: (r["terms"], r["doc"]) for r in I.termize(names).collect()}
    assert got == {"e1": (["pars", "file"], "pars_file"), "e2": ([], ""), "e3": ([], "")}
    two = spark.createDataFrame([(["a", "b", "c"],)], "t array<string>")
    assert two.select(I.bigramize(F.col("t"), 2).alias("b")).first()["b"] == ["a-b", "a-c", "b-c"]
    assert two.select(I.bigramize(F.col("t"), 0).alias("b")).first()["b"] == []
