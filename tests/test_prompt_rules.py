from pyspark.sql import functions as F

from claimloom.functions import text as tx
from claimloom.operators import drafting, prompts
from claimloom.operators.claims import sentence_spans


def test_prompts_state_every_rule_where_it_belongs(spark):
    chunks = spark.createDataFrame([(0, 1, "Apples are widgets."), (0, 2, "A widget bears a tariff.")], "id long, at int, text string")
    rows = prompts.context(chunks, by="id", order="at").withColumns({"q": F.lit("In Burnett v. United States, what did the Court decide?"), "plain": F.lit("what is the tariff?"), "general": F.lit("detailed")})
    of = lambda **kw: rows.select(drafting.prompt(**kw).alias("p")).first().p
    named = of(question=F.col("q"), context="context")
    for rule in ("supported", "caption", "denial", "holding", "insufficient", "no_lists"):
        assert drafting.RULES[rule] in named
    assert drafting.RULES["hyphens"] not in named
    detailed = of(question=F.col("q"), context="context", depth="general")
    assert drafting.RULES["detail"] in detailed and drafting.RULES["hyphens"] in detailed and drafting.RULES["no_lists"] not in detailed
    unnamed = of(question=F.col("plain"), context="context")
    assert drafting.RULES["supported"] not in unnamed and "Context item 1:" in unnamed and "Context item 2:" in unnamed and "[1]" not in unnamed


def test_guarded_sentences_equal_the_row_form_on_a_whole_table(spark):
    hard = ["Mr. Smith v. Jones Co. lost. He sued in D. C. on 42 U. S. C. 1983! See No. 12, F. 3d 4 (e.g. here).", "J. P. Morgan Inc. paid. A. B. C. won? Yes", "Énos. no. fin. U.S. law", "", "...", "Id. at 3. Prof. X. Y. spoke.", None]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").unionByName(spark.createDataFrame([(t,) for t in hard], "text string"))
    for r in docs.select("text", tx.guarded_sentences("text").alias("s")).collect():
        if r.text is None:
            assert r.s is None
        else:
            assert r.s == [r.text[a:b].strip() for a, b in sentence_spans(r.text)]
