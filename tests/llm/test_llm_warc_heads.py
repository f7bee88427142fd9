"""Heads of any length are kept whole."""

from sightline.llm import warc


def test_every_header_line_is_kept(spark):
    block = "HTTP/1.1 200 OK" + "".join(f"\r\nX-{i}: y" for i in range(10_050))
    made = warc.derivatives(spark.createDataFrame([("<urn:1>", "u", "d", block, "sha1:x")], "record_id string, target_uri string, date string, block string, payload_digest string"))
    assert sum(bytes(r.record).count(b"http-header: ") if not isinstance(r.record, str) else r.record.count("http-header: ") for r in made.collect()) == 10_050
