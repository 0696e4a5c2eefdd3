"""op4_url_filter: the tree rejects pages by given labels."""

from footfall.llm import url_templates


def test_labels_reject_pages_without_a_rule(spark):
    pages = [(i, f"http://h.example/{'spam' if i % 2 else 'news'}/item{i}") for i in range(400)]
    labels = [(i, i % 2) for i in range(200)]
    judged = url_templates.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad int"), rules=url_templates.RULES)
    got = {r.page_id: (r.rule, r.verdict) for r in judged.collect()}
    assert got == {i: (None, "block" if i % 2 else "allow") for i in range(400)}


def test_unlabelled_pages_are_not_rejected(spark, small):
    judged = url_templates.judge(spark.read.parquet(small.replace("sf0.001", "sf0.1") + "/pages.parquet").select("page_id", "url"))
    free = judged.where("rule is null")
    assert (free.count(), free.where("verdict = 'block'").count()) == (1407, 0)
