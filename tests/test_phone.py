"""phone_optin looks at every line, whatever it starts with."""

from maskwright.plans import catalog


def test_phones_in_all_lines_count(spark, monkeypatch):
    lines = [(1, "call 415-555-0001 today"), (2, "dial 415-555-0002 today"), (3, "from 10.0.0.7 ok"), (4, "fax 415-555-0003, desk 415-555-0004")]
    monkeypatch.setattr(catalog, "logs", lambda *_: spark.createDataFrame(lines, "id long, text string"))
    assert [tuple(r) for r in catalog.QUERIES["phone_optin"](spark, "").collect()] == [(4, 0)]
