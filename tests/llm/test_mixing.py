"""The classifier of the mixing works once a row."""

import re

from pyspark.sql import functions as F

from sitefit.llm.mixing import posteriors


def test_the_model_is_not_evaluated_for_every_domain(small):
    docs, labels = small
    marks = docs.select("doc_id", F.col("lang").alias("domain")).join(labels.select("doc_id"), "doc_id", "left_semi")
    found, domains = posteriors(docs, marks)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert len(domains) > 1 and "UDF" in plan and not re.search(r"lambdafunction\([^\n]*UDF", plan)
