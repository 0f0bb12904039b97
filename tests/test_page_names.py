import re

from attesta.functions import web
from attesta.plans import catalog


def test_names_far_into_long_texts(spark, tmp_path):
    said = ["CEO: Kari Hansen.", "daglig leder Per Olsen;", "Styreleder - Ola Berg Lund.", "CFO: Ann Lie.", "CTO Bo Ek."]
    texts = [
        said[0] + "\n" + "plain words. " * 2000 + "\n" + said[1] + "\n",
        "x" * 190 + "\n" + said[2] + "\n" + "y, " * 50_000 + "\n" + said[3] + "\n" + said[4],
        "\n".join(said * 2),
        "CEO: Kari og Per\n" + "z" * 300 + "\nchair Eva Dahl\n",
        "no one here",
        "",
        None,
    ]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for k, text in enumerate(texts):
        found = [(m.group(2).strip().rstrip(".,;"), label) for role, label in web.ROLES for m in re.finditer(role + web.ROLE_NAME, text or "", re.I)]
        fit = [(n, label) for n, label in found if 2 <= len(n.split()) <= 5 and "og" not in n.split()]
        want += [(k, "Kari Nordmann", "CEO"), *((k, *x) for x in fit[:8])]
    got = [tuple(r) for r in catalog.QUERIES["page_names"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and len(got) == 7 + 2 + 3 + 8 + 1
