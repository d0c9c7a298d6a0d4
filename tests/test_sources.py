"""Payload reshape, CSV with preamble, XML catalogue, HTML tables (ops 1.5-1.13)."""

import json
import os


from furrow.functions.text import decode_entities
from furrow.plans.catalog import html_table_rows
from furrow.sources import files, payloads


def test_point_series_json(spark, tmp_dir):
    payload = {"properties": {"parameter": {
        "T2M": {"20240101": 10.5, "20240102": -999.0},
        "PRECTOTCORR": {"20240101": 0.0, "20240102": 1.2}}}}
    p = os.path.join(tmp_dir, "p.json")
    with open(p, "w") as f:
        json.dump(payload, f)
    df = payloads.read_point_series(spark, p)
    long = payloads.point_series_to_long(df).orderBy("parameter", "date").collect()
    assert [(str(r.date), r.parameter, r.value) for r in long] == [
        ("2024-01-01", "PRECTOTCORR", 0.0), ("2024-01-02", "PRECTOTCORR", 1.2),
        ("2024-01-01", "T2M", 10.5), ("2024-01-02", "T2M", -999.0)]
    wide = payloads.point_series_to_wide(df, ["T2M", "PRECTOTCORR"]).collect()
    assert [r.T2M for r in wide] == [10.5, -999.0]


def test_arrays_and_regular_series(spark):
    df = spark.createDataFrame([({"time": ["2024-01-01", "2024-01-02"], "t": [1.0, None]},)],
                               "daily struct<time: array<string>, t: array<double>>")
    rows = payloads.arrays_to_rows(df, "time", ["t"], prefix="daily").collect()
    assert [(r.time, r.t) for r in rows] == [("2024-01-01", 1.0), ("2024-01-02", None)]
    reg = spark.createDataFrame([(0, 3 * 3600, [1.0, 2.0, 3.0])], "start long, end long, p array<double>")
    out = payloads.regular_series_to_rows(reg, "start", "end", 3600, ["p"]).collect()
    assert [(str(r.date), r.p) for r in out] == [("1970-01-01 00:00:00", 1.0), ("1970-01-01 01:00:00", 2.0),
                                                 ("1970-01-01 02:00:00", 3.0)]


def test_csv_with_preamble(spark, tmp_dir):
    p = os.path.join(tmp_dir, "export.csv")
    with open(p, "w") as f:
        f.write("latitude,longitude,elevation\n36.8,10.2,12.0\n\n"
                "time,temperature_2m_mean (°C),extra\n2025-01-01,12.5,x\n2025-01-02,,y\n")
    df = files.read_csv_skip_preamble(spark, p, "time string, t string, extra string", skip_lines=3,
                                      renames={"time": "date"}, date_cols=["date"])
    got = [(str(r.date), r.t) for r in df.orderBy("date").collect()]
    assert got == [("2025-01-01", "12.5"), ("2025-01-02", None)]


XML = """<?xml version="1.0"?>
<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:dcat="http://www.w3.org/ns/dcat#"
         xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:dct="http://purl.org/dc/terms/">
<dcat:Dataset xml:id="TN-001">
  <dc:title>Soil map</dc:title><dc:creator>INRAT</dc:creator>
  <dc:subject>soil</dc:subject><dc:subject>maps</dc:subject>
  <dcat:distribution><dcat:Distribution><dcat:downloadURL>http://x/a.zip</dcat:downloadURL></dcat:Distribution></dcat:distribution>
</dcat:Dataset>
<dcat:Dataset>
  <dc:title>Rain</dc:title>
</dcat:Dataset>
</rdf:RDF>
"""


def test_catalog_xml(spark, tmp_dir):
    p = os.path.join(tmp_dir, "cat.xml")
    with open(p, "w") as f:
        f.write(XML)
    rows = files.read_catalog_xml(spark, p).orderBy("title", ascending=False).collect()
    assert rows[0].id == "TN-001" and rows[0].subjects == ["soil", "maps"]
    assert rows[0].download_url == "http://x/a.zip" and rows[0].description == ""
    assert rows[1].id == "Unknown" and rows[1].subjects == [] and rows[1].download_url is None


HTML = """<p>Table 12</p><table class="kc">
<tr><td>Crop</td><td>x</td><td>Kc ini</td><td>Kc mid</td></tr>
<tr><td colspan="6"><b>a. Small&nbsp;Vegetables</b></td></tr>
<tr><td></td><td>- too early</td><td>9</td><td>9</td></tr>
<tr><td>Broccoli</td><td></td><td>0.7</td><td>1.05</td></tr>
<tr><td></td><td>- Winter</td><td>0.6</td><td>1.0<sup>3</sup></td></tr>
<tr><td></td><td>- bare</td></tr>
<tr><TD colspan="2">Peas &amp; B&#233;ans</TD><td>0.5</td></tr>
<tr><td></td><td>Beet</td><td>0.3</td><td>1.1</td><td>0.9</td><td>0.4</td><td>note</td></tr>
<tr><td>No value</td><td></td><td> </td></tr>
<tr><td></td><td>- of none</td><td>0.1</td></tr>
<tr><td>alone</td></tr>
<tr><td colspan="2"><b>b. Roots</b></td><td>0.4</td><td>see note</td></tr>
<tr><td></td><td>- orphan</td><td>1</td></tr>
<tr><td><b>C. Legumes</b></td><td></td><td></td><td></td></tr>
<tr><td>Beans</td><td></td><td>0.4</td><td>1.15</td></tr>
</table><table><tr><td>h</td></tr><tr><td>Other</td><td></td><td>1</td></tr></table>"""


def test_html_table_rows(spark):
    pages = spark.createDataFrame([(1, HTML), (2, None), (3, "no table"), (4, "<table></table>")], "page_id long, html string")
    rows = html_table_rows(pages, "page_id", "html").orderBy("page_id", "row_no").collect()
    got = [(r.category, r.crop, r.variant, r.kc_ini, r.kc_mid, r.kc_end, r.max_height_m, list(r.further)) for r in rows]
    small = "Small Vegetables"
    assert got == [(small, "Broccoli", None, "0.7", "1.05", None, None, []),
                   (small, "Broccoli", "Winter", "0.6", "1.0", None, None, []),
                   (small, "Broccoli", "bare", None, None, None, None, []),
                   (small, "Peas & B\u00e9ans", None, "0.5", None, None, None, []),
                   (small, "Beet", None, "0.3", "1.1", "0.9", "0.4", ["note"]),
                   (small, "No value", "of none", "0.1", None, None, None, []),
                   ("Roots", "Roots", None, "0.4", None, None, None, []),
                   ("C. Legumes", "Beans", None, "0.4", "1.15", None, None, [])]


def test_decode_entities(spark):
    texts = ["a &lt;b&gt; &#x41;&#66;", "&amp;lt; &amp;#65;", "&#0; &#55296; &#99999; &unknown; &#", "", None]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(decode_entities("t")).collect()]
    assert got == ["a <b> AB", "&lt; &#65;", "&#0; &#55296; &#99999; &unknown; &#", "", None]
