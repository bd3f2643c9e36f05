import zipfile

from spanloom.plans import corpus
from spanloom.operators import match
from spanloom.sources import ingest, package, results


def test_import_files(spark, tmp_path):
    (tmp_path / "cats.txt").write_text("tid\ntitle\tThe Title\nyear\t\tlist\tinteger\n")
    cats = ingest.categories(spark, str(tmp_path / "cats.txt")).orderBy("position").collect()
    assert [(c.short_name, c.name, c.category_type, c.value_type) for c in cats] == [("tid", "Tid", "list", "text"), ("title", "The Title", "list", "text"), ("year", "Year", "list", "integer")]
    (tmp_path / "data.tsv").write_text("t1\t Peer Gynt \t1867\nt2\t\\N\t\n")
    rows = ingest.values(spark, str(tmp_path / "data.tsv"), ["tid", "title", "year"]).orderBy("tid").collect()
    assert [tuple(r) for r in rows] == [("t1", "Peer Gynt", "1867"), ("t2", None, None)]
    (tmp_path / "l1.tsv").write_bytes("t1\tbl\xe5\n".encode("latin-1"))
    assert ingest.values(spark, str(tmp_path / "l1.tsv"), ["tid", "title"], encoding="ISO-8859-1").first().title == "blå"
    spoken = spark.createDataFrame([(1, "3-9 12-20")], "text_id int, positions string")
    assert [tuple(r)[1:] for r in ingest.ranges(spoken).collect()] == [(3, 9), (12, 20)]


def test_packages(spark, tmp_path):
    path = tmp_path / "My_Corp1.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("cwb_reg/my_corp", "# {name: My corpus, encoding: utf-8, config: {context_size: 7}}\n")
        z.writestr("../evil", "x")
    assert package.unpack(str(path), str(tmp_path / "out")) == "my_corp"
    header = package.registry_header((tmp_path / "out/cwb_reg/my_corp").read_text())
    assert header["name"] == "My corpus" and header["config"] == {"context_size": 7}
    assert package.catalog(spark, {"my_corp": header}).first().config["context_size"] == "7"
    tags = package.flat_yaml("tags:\n  attr: pos\n  options:\n  - name: noun\n    value: N\n    features:\n    - attr: num\n      options:\n      - {value: sg}\n  - name: verb\n")
    rows = package.menu(spark, tags).collect()
    assert [(r.pos, r.feature_attr, r.label) for r in rows] == [("N", "num", "sg"), ("verb", None, None)]
    assert "multilingual" in package.cimdi({"name": "x", "cimdi": {"languages": ["en", "no"]}}, {"no": "Norwegian"})


def test_saved_results(spark, data, tmp_path):
    rows = corpus.sentences(corpus.table(spark, data, "documents"))
    hits = match.match(rows, '[word="of"] [word="the"]')
    results.save_hits(hits, str(tmp_path), "1")
    a = results.read_page(spark, rows, str(tmp_path), "1", 0, 4).select("text_id", "s_no", "first").collect()
    assert a == match.cut(hits, 5).select("text_id", "s_no", "first").collect()
    assert results.bound_sql("select from #TARGET where &f = ?", "#1:2", f="name") == "select from #1:2 where name = ?"
