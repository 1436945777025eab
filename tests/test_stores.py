"""Language packs as data, store discovery, snapshots, resumed commits, and guides that are written and read back."""

import os

import pytest

from corpusloom.functions import packs
from corpusloom.operators import style
from corpusloom.sources import stores


def test_packs_are_data(spark, tmp_path):
    for name, text in {"hedges": "# remark\nforse\nmagari\n", "openers": "e\nma\n", "contractions": r"\bc'è\b" + "\n"}.items():
        os.makedirs(tmp_path / "xx", exist_ok=True)
        (tmp_path / "xx" / f"{name}.txt").write_text(text, encoding="utf-8")
    rows = spark.createDataFrame([(1, "Forse viene. Ma c'è tempo. Magari no.", "xx", "t")], "key int, text string, lang string, type string")
    assert style.sums(rows).first()["hedges"] is None
    try:
        assert packs.load(str(tmp_path)) == {"xx": ["hedges", "openers", "contractions"]}
        got = style.sums(rows).first()
        assert (got["hedges"], got["openers"], got["contractions"]) == (2, 1, 1)
        (tmp_path / "xx" / "hedges.txt").write_text("Forse\n", encoding="utf-8")
        with pytest.raises(ValueError, match="lower case"):
            packs.load(str(tmp_path))
    finally:
        for lists in packs.LISTS.values():
            lists.pop("xx", None)


def test_stores_snapshots_and_commits(spark, tmp_path):
    for place in ("a/s", "a/s/inner", "b/c/d/e", ".hidden"):
        os.makedirs(tmp_path / place)
        (tmp_path / place / "store.yaml").write_text("x")
    found = [p.split(str(tmp_path))[1] for p in stores.discover(spark, str(tmp_path), "store.yaml")]
    assert found == ["/a/s"]
    spark.range(3).write.parquet(str(tmp_path / "t"))
    names = [stores.snapshot(spark, str(tmp_path / "t"), str(tmp_path / "copy")) for _ in range(2)]
    assert names[1] == names[0] + "-2" and spark.read.parquet(names[1]).count() == 3
    done = []

    def fails():
        raise RuntimeError("lost")

    steps = {"one": lambda: done.append(1), "two": fails}
    with pytest.raises(RuntimeError):
        stores.commit(spark, str(tmp_path / "journal"), steps)
    assert stores.commit(spark, str(tmp_path / "journal"), steps | {"two": lambda: done.append(2)}) == ["two"] and done == [1, 2]


def test_guides_come_back_as_they_were(spark):
    rows = [("sam", "words", "r2", "no jargon", None), ("sam", "words", "r1", "use tea", "en.note"), ("sam", "marks", "r3", "no dashes", None), ("kim", "words", "r1", "be (very) brief", None)]
    rulings = spark.createDataFrame(rows, "profile string, kind string, id string, text string, slot string")
    pages = stores.guide(rulings)
    assert pages.where("profile = 'sam'").first()["markdown"] == "## marks\n\n- **r3** no dashes\n\n## words\n\n- **r1** use tea (en.note)\n- **r2** no jargon"
    assert sorted(tuple(r) for r in stores.guide_rulings(pages).collect()) == sorted(rows, key=lambda r: tuple(map(str, r)))
