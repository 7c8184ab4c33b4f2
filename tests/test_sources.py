import datetime as dt

import pytest

from ledgerlight.operators import registry
from ledgerlight.sources import ingest, receipts, sinks

HTML = b"""From: Lumen Storage <hello@lumen.example>
Subject: Your renewal is confirmed
Date: Mon, 03 Mar 2025 07:00:00 +0000
MIME-Version: 1.0
Content-Type: text/html; charset="utf-8"

<html><head><style>p { x: 1 }</style></head><body><!-- $77.00 --><h2>Receipt</h2><p>Lumen Vault</p><p>renews each month</p><table><tr><td>Service</td><td>Lumen Vault</td></tr>
<tr><td>Billing date</td><td>Mar 2, 2025</td></tr></table><p>Subtotal $6.00</p><p>Tax $0.48</p><p>Total $6.48</p>
<script>var price = "$99.99"</script><a href="https://lumen.example/faq">Questions</a> <a class="b" href='https://lumen.example/plan'>Manage <b>plan</b></a></body></html>
"""
PLAIN = b"""From: Billing Robot <payments@harbor-yoga.squareup.com>
Subject: Order 4417
Date: Fri, 07 Feb 2025 18:12:00 +0100

Seller: Harbor Yoga
Purchase date: 02/06/2025
Mat rental $4.50
Tip $2.00
You were charged $31.50
"""


def test_csv_json_records(spark):
    good, bad = ingest.csv_text(spark, b"\xef\xbb\xbfMerchant;Amount;Posted Date;memo\nNETFLIX;\"$1,015.49\";2026-01-02;m\n;1;2026-01-01;\nY;abc;2026-01-01;\nZ;3;soon;\n")
    assert [(r.merchant_raw, r.amount, r.date, r.currency, r.description) for r in good.collect()] == [("NETFLIX", 1015.49, dt.date(2026, 1, 2), "USD", "m")]
    assert [r.row_no for r in bad.orderBy("row_no").collect()] == [2, 3, 4]
    good, bad = ingest.json_text(spark, '{"transactions": [{"merchant_raw": "A", "amount": 3, "date": "2026-01-01T10:00", "id": "t1"}, 5]}')
    assert good.first().transaction_id == "t1" and bad.count() == 1
    for wrong in ("", "{", "5", '{"x": 1}'):
        with pytest.raises(ValueError, match="JSON"):
            ingest.json_text(spark, wrong)
    with pytest.raises(ValueError, match="empty"):
        ingest.csv_text(spark, "  ")


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("description,value,txn_date\nX,5,01/31/2026\n")
    good, _ = ingest.csv_files(spark, str(tmp_path / "a.csv"))
    assert (good.first().merchant_raw, good.first().date) == ("X", dt.date(2026, 1, 31))
    (tmp_path / "a.json").write_text('{"payee": "X", "charge": 5, "date": "20260131"}\n')
    assert ingest.json_files(spark, str(tmp_path / "a.json"))[0].first().amount == 5.0


def test_mails(spark, tmp_path):
    for name, content in (("a.eml", HTML), ("b.eml", PLAIN), ("c.eml", b"\n")):
        (tmp_path / name).write_bytes(content)
    rows = {r.path[-5:]: r for r in receipts.read_mails(spark, str(tmp_path)).collect()}
    a, b = rows["a.eml"], rows["b.eml"]
    assert (a.merchant_raw, a.amount, a.date, [x.url for x in a.action_links]) == ("Lumen Vault", 6.48, dt.date(2025, 3, 2), ["https://lumen.example/plan"])
    assert (b.merchant_raw, b.amount, b.date) == ("Harbor Yoga", 31.50, dt.date(2025, 2, 6)) and rows["c.eml"].error
    read = receipts.read_mails(spark, str(tmp_path))
    assert receipts.charges(read).count() == 2 and [r.path[-5:] for r in receipts.rejects(read).collect()] == ["c.eml"]


def test_receipt_text():
    r = receipts.receipt("Subtotal $40.00\nShipping $5.25\nGrand total $45.25", subject="Invoice from Paper Mill", date=dt.date(2025, 5, 5))
    assert (r["merchant_raw"], r["amount"], r["merchant_source"]) == ("Paper Mill", 45.25, "subject") and r["warnings"]
    assert receipts.receipt("Your plan was billed at $8.00", merchant="Paper Mill")["amount"] == 8.0
    assert receipts.prices("was $9.99, discount $2.00\ntotal 1,207.99 USD") == [1207.99, 2.0, 9.99]
    assert receipts.payee_of_subject("Receipt from Paper Mill") == "Paper Mill" and receipts.payee_of_subject("Fresh Bread") == "Fresh Bread" and receipts.payee_of_subject("Invoice") is None
    assert receipts.receipt("1.00")["error"] and receipts.receipt("Paper Mill\nno sum")["error"]


def test_payees_by_rule():
    sender = lambda x: list(receipts.by_sender(x))
    assert sender("Paper Mill <a@b.paper-mill.example>") == [("Paper Mill", 0.74, "from-name"), ("Paper Mill", 0.68, "from-domain")]
    assert sender("x@gmail.com") == sender("x@mail.gmail.com") == sender("nobody") == sender("") == []
    assert sender("a@rose-cafe.stripe.com") == [("Rose Cafe", 0.45, "from-domain")] and sender("a@stripe.com") == [("Stripe", 0.45, "from-domain")]
    assert list(receipts.labelled(["Merchant:", "$4.00", "2025-01-01", "Tea House", "Tea Room"])) == [("Tea House", 0.98, "body-merchant")]
    assert list(receipts.labelled(["Plan", "Date", "Tea House", "App", "$1.00", "$2.00", "$3.00", "Tea House"])) == []
    assert [t[:2] for t in receipts.titles(["Receipt", "Tea House", "Renews monthly", "Dear Ann"], "Receipt 5")] == [("Tea House", pytest.approx(0.99))]
    assert [receipts.candidate(x) for x in ("the Tea House - order 5", "Tea House via Stripe, Inc.", "(Tea&amp;Co.)", "pay 3.50", "hi", "AT&T", "no-reply", "Tea House with 2 seats")] == ["Tea House", "Tea House", "Tea&Co", None, None, "AT&T", None, "Tea House"]


def test_html_expressions_agree_with_the_parser(spark):
    source = HTML.decode().split("\n\n", 1)[1]
    df = spark.createDataFrame([(source,), (None,)], "html string")
    row = df.select(receipts.html_text(df.html).alias("t"), receipts.action_links(df.html).alias("l")).first()
    text, links = receipts.page(source)
    assert row.t == text and [(x.label, x.url) for x in row.l] == links


def test_registry_round_trip(spark, tmp_path):
    path = str(tmp_path / "registry")
    assert sinks.read_registry(spark, path).count() == 0
    sinks.write_registry(registry.seeds(spark), path, 1)
    sinks.write_registry(registry.seeds(spark).limit(3), path, 2)
    assert sinks.read_registry(spark, path).count() == 3


def test_best_amount_reads_all_orders(spark, tmp_path):
    from ledgerlight.queries import best_amount

    rows = [(k, 1234.5 + k) for k in (1, 2000, 2001, 150_000, 9_000_000_000)]
    spark.createDataFrame(rows, "o_orderkey long, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    assert sorted(map(tuple, best_amount(spark, str(tmp_path)).collect())) == [(k, x, "Canva") for k, x in rows]


def test_demo_and_template(spark):
    from ledgerlight.sources import demo

    assert len(demo.rows(False)) == 44 and len(demo.rows()) == 52 and len({r[0] for r in demo.rows()}) == 52
    apple = [r[2:4] for r in demo.rows(False) if r[1] == "APPLE.COM/BILL"]
    assert [a for a, _ in apple] == [2.99, 9.99, 2.99, 9.99, 2.99, 9.99, 2.99, 14.99] and apple[0][1] == apple[1][1] == dt.date(2025, 11, 5) and apple[-1][1] == dt.date(2026, 2, 5)
    good, bad = ingest.csv_text(spark, demo.template())
    rows = good.orderBy("transaction_id").collect()
    assert len(rows) == 12 and bad.count() == 0 and (rows[4].merchant_raw, rows[4].amount, rows[4].date) == ("NETFLIX.COM", 59.99, dt.date(2026, 3, 1)) and rows[0].category_mcc is None


def xlsx(path, sheets):
    import zipfile
    from xml.sax.saxutils import escape

    head = '<?xml version="1.0"?>'
    words = [c for _, rows in sheets for r in rows for c in r if isinstance(c, str)]
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/sharedStrings.xml", head + "<sst>" + "".join(f"<si><t>{escape(w)}</t></si>" for w in words) + "</sst>")
        z.writestr("xl/workbook.xml", head + '<workbook xmlns:r="r"><sheets>' + "".join(f'<sheet name="{n}" r:id="i{k}"/>' for k, (n, _) in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", head + "<Relationships>" + "".join(f'<Relationship Id="i{k}" Target="worksheets/s{k}.xml"/>' for k in range(len(sheets))) + "</Relationships>")
        for k, (_, rows) in enumerate(sheets):
            cell = lambda n, i, c: f'<c r="{"ABCDEFGHIJ"[i]}{n}" t="s"><v>{words.index(c)}</v></c>' if isinstance(c, str) else f'<c r="{"ABCDEFGHIJ"[i]}{n}"><v>{c}</v></c>'
            body = "".join(f"<row>{''.join(cell(n, i, c) for i, c in enumerate(r) if c is not None)}</row>" for n, r in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/s{k}.xml", f"{head}<worksheet><sheetData>{body}</sheetData></worksheet>")


def test_workbooks(spark, tmp_path):
    from ledgerlight.operators import guidance
    from ledgerlight.sources import workbook

    header = ["#", "Provider", "2026 Market  Share", "Price Range", "Website", "How / Cancellation"]
    xlsx(tmp_path / "a.xlsx", [
        ("Index", [header, [1, "Not read", None, None, None, "x"]]),
        ("Music", [["A title"], [None, "and a note"], header, [3, "Tune Box / TB", "5 %", "$5", "tunebox.example", "Go to https://tunebox.example/end."], [4, "Provider", "", "", "", "again"], [5, "# note", "", "", "", "x"], [6, "No process"], [None, "Late Radio", None, None, None, "Write <to> us"]]),
        ("Empty", []),
    ])
    found = {r.service_name: r for r in workbook.guides(spark, str(tmp_path / "a.xlsx")).collect()}
    assert set(found) == {"Tune Box / TB", "Late Radio"}
    box = found["Tune Box / TB"]
    assert (box.ord, box.category, box.market_position, box.manage_url, box.aliases, box.website) == (3, "Music", "5 %", "https://tunebox.example/end", ["Tune Box / TB", "Tune Box", "TB"], "tunebox.example")
    assert found["Late Radio"].cancellation_process == "Write <to> us" and found["Late Radio"].notes
    names = spark.createDataFrame([("TUNE BOX 99999", None), ("NETFLIX.COM", None), ("Tune Box", None), ("Nobody", "news")], "name string, category string")
    out = guidance.listed(guidance.guide(names, workbook.guides(spark, str(tmp_path)).unionByName(guidance.built_in(spark)))).collect()
    assert [(r.service_name, r.source) for r in out] == [("Tune Box / TB", "xlsx_database"), ("Netflix", "built_in_database"), ("Nobody", "web_search")]
    assert out[1].steps[1] == "Select Cancel." and "1. Sign in" in out[1].cancellation_process and out[2].notes[0] == "Detected category: news." and "Web search: https" in out[2].cancellation_process
    assert workbook.database_path(spark) is None or workbook.database_path(spark).endswith(".xlsx")
    spark.conf.set(workbook.SETTING, str(tmp_path / "a.xlsx"))
    assert workbook.database_path(spark) == str(tmp_path / "a.xlsx")
    spark.conf.unset(workbook.SETTING)


def test_numbered_rows_of_files(spark, tmp_path):
    (tmp_path / "csv").mkdir()
    for k in range(3):
        (tmp_path / "csv" / f"{k}.csv").write_text("payee;amount;date\n" + "".join(f"P{k}-{n};{n}.5;2025-01-0{n + 1}\n" for n in range(4)) + ";1;2025-01-01\n")
    good, bad = ingest.csv_files(spark, str(tmp_path / "csv"))
    seqs = sorted([r.seq for r in good.collect()] + [r.row_no for r in bad.collect()])
    assert seqs == list(range(1, 16)) and bad.count() == 3
    (tmp_path / "lines.json").write_text('{"payee": "X", "charge": 5, "date": "20260131"}\n{"payee": "Y", "charge": "6", "date": "20260131"}\n')
    (tmp_path / "array.json").write_text('[\n{"payee": "X", "charge": 5, "date": "20260131"},\n{"payee": "Y", "charge": 6, "date": "20260131"}]')
    (tmp_path / "wrapped.json").write_text('{"transactions": [\n{"payee": "X", "charge": 5, "date": "20260131"}, {"payee": "Y", "charge": 6, "date": "soon"}], "more": 1}')
    for name, n in (("lines", 2), ("array", 2), ("wrapped", 1)):
        good, bad = ingest.json_files(spark, str(tmp_path / f"{name}.json"))
        assert (good.count(), bad.count()) == (n, 2 - n) and good.orderBy("seq").first().seq == 1, name
    with pytest.raises(ValueError, match="empty"):
        (tmp_path / "none.csv").write_text(" ")
        ingest.csv_files(spark, str(tmp_path / "none.csv"))
