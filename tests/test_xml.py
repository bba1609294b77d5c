"""XML values as expressions, against a streaming parser on whole, torn and damaged documents."""

import random
from xml.parsers import expat

from pyspark.sql import functions as F

from tidemark.functions.xmlcols import first_values, unescape
from tidemark.operators import textual
from tidemark.plans import records_from_tables as R
from tidemark.sources import textfiles

FIELDS = {"date": ("Info", "Date"), "start": (None, "Start")}
SPACE = "\t\n\x0b\x0c\r \x85\xa0"


def by_parser(xml):
    found, stack, text = {}, [], []

    def start(tag, _attributes):
        if tag.rpartition(":")[2].endswith("Trigger"):
            found.setdefault("kind", tag.rpartition(":")[2])
        stack.append(tag.rpartition(":")[2])
        text.clear()

    def end(_tag):
        value, tag = "".join(text).strip(SPACE), stack.pop()
        for field, (parent, name) in FIELDS.items():
            if value and tag == name and (parent is None or stack[-1:] == [parent]):
                found.setdefault(field, value)
        text.clear()

    parser = expat.ParserCreate()
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, text.append
    try:
        parser.Parse(xml, True)
    except expat.ExpatError:
        pass
    return tuple(found.get(c, "") for c in ("date", "start", "kind"))


def read(spark, documents):
    df = spark.createDataFrame(list(enumerate(documents)), "n int, xml string")
    rows = df.select("n", first_values(F.col("xml"), FIELDS, ("kind", "Trigger")).alias("v")).orderBy("n").collect()
    return [tuple(r.v) for r in rows]


WHOLE = ['<T xmlns="u"><Info><Date> 2024 </Date><Date>late</Date></Info><ATrigger a="x>y" b=\'<\'/></T>'.replace("'<'", "'>'"),
         "<p:T><p:Info><p:Date><![CDATA[a<b>&c]]>&amp;lt;</p:Date></p:Info><p:BTrigger><p:Start>1</p:Start></p:BTrigger></p:T>",
         "<T><Info><Date></Date><Date>x<i>inner</i>tail</Date></Info><!-- <Start>no</Start> --><Start>&#65;&#x1F600;&#38;lt; <!-- c -->z</Start></T>",
         "<T><Date>outside</Date><Info><X><Date>deeper</Date></X></Info><Start>  y \n</Start ></T>",
         "<T><?pi <Start>?><Start>&quot;q&apos; &gt;</Start><CTrigger/><DTrigger/></T>"]


def test_whole_documents(spark):
    assert read(spark, WHOLE) == [by_parser(x) for x in WHOLE]
    assert read(spark, [None, "", "no marks", "<"]) == [("", "", "")] * 4


def test_every_torn_document(spark):
    torn = [x[:n] for x in WHOLE for n in range(len(x))]
    assert read(spark, torn) == [by_parser(x) for x in torn]


def test_damaged_documents(spark):
    wrong = ["<T><Start>1</Start><Info><Date>2</Info></Date></T>", "<T><Start>1</Start>&nope;<Info><Date>2</Date></Info></T>",
             "<T><Start>1</Start></U><Info><Date>2</Date></Info>", "<T><Start>a&b</Start></T>", "</T><Start>1</Start>", "<T><><Start>1</Start></T>"]
    assert read(spark, wrong) == [by_parser(x) for x in wrong]
    pieces = ["<Info>", "</Info>", "<Date>", "</Date>", "<Start>", "</Start>", "<ETrigger>", "</ETrigger>", "<FTrigger/>", "a", " ", "&amp;", "&#66;", "<!--x-->"]
    rng = random.Random(5)
    mixed = ["<T>" + "".join(rng.choice(pieces) for _ in range(rng.randint(1, 14))) + "</T>" for _ in range(400)]
    assert read(spark, mixed) == [by_parser(x) for x in mixed]


def test_long_documents(spark):
    filler = "".join(f"<x k{i % 7}='v'>{'word ' * 20}</x>" for i in range(3000))
    assert read(spark, [f"<T>{filler}<Info><Date>d</Date></Info>{'y' * 300_000}</T>", "<a " + "k='v' " * 20_000 + "/>"]) == [("d", "", ""), ("", "", "")]


def test_references(spark):
    row = spark.range(1).select(unescape(F.lit("&amp;#65; &#65; &lt;&#38;amp;&#x20AC;")).alias("t")).first()
    assert row.t == "&#65; A <&amp;€"


def test_no_python_and_no_exchange(spark):
    sf = "/root/testdata/sf0.001"
    tasks = textual.task_events(textfiles.parse_tasks(R.task_files(spark, sf), root="Tasks"))
    reports = textual.wer_events(textfiles.parse_wer(R.wer_files(spark, sf)))
    for df in (tasks, reports):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
