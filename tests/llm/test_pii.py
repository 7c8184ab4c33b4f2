import datetime as dt
import random
import re

import brute

from ledgerlight.llm import pii


def luhn_ok(s):
    d = [int(c) for c in re.sub(r"\D", "", s)][::-1]
    return sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(d)) % 10 == 0


def test_formats_and_links(spark):
    given = ["4532015112830366", "4532-0151-1283-0366", "GB82 WEST 1234 5698 7654 32", "2024-02-29", "31.12.1999", "12/31/1999", "078-05-1120", "10.1.2.255", "+1 (017) 555-7713", "a.b@mail.example.com", "9742a250774262d69ad6a86100194ed53da5a0ef"]
    kept = ["4532015112830367", "DE00 3704 0044 0532 0130 00", "2023-02-29", "666-05-1120", "300.1.2.3", "1234", "1.2.3.4.5", "v2.0"]
    df = spark.createDataFrame([(k, f"x {t}, {t}!") for k, t in enumerate(given + kept)] + [(98, None), (99, "")], "doc_id long, text string")
    out = {r.doc_id: r for r in pii.pseudonymised(df).collect()}
    for k, t in enumerate(given):
        first, second = re.fullmatch(r"x (.*), (.*)!", out[k].text).groups()
        assert first == second != t and out[k].n_pii == 2
        if k not in (9, 10):
            assert re.sub(r"\d+" if k == 7 else r"\d", "9", first) == re.sub(r"\d+" if k == 7 else r"\d", "9", t)
    for k, t in enumerate(kept, len(given)):
        assert out[k].text == f"x {t}, {t}!" and out[k].n_pii == 0
    cards = [re.search(r"x (.*),", out[k].text)[1] for k in (0, 1)]
    assert all(map(luhn_ok, cards)) and cards[0] == cards[1].replace("-", "")
    assert (out[98].text, out[98].n_pii, out[99].text) == (None, 0, "")


def test_permutation_has_no_collisions_and_valid_results(spark):
    rows = [(k, f"2000-01-{k % 28 + 1:02d} {k // 28:02d}", ) for k in range(280)]
    dates = spark.createDataFrame([(k, f"{2000 + k // 336}-{k // 28 % 12 + 1:02d}-{k % 28 + 1:02d}") for k in range(3000)], "doc_id long, text string")
    out = [r.text for r in pii.pseudonymised(dates).collect()]
    assert len(set(out)) == 3000 and all(re.fullmatch(r"\d{4}-\d{2}-\d{2}", x) for x in out) and rows
    ssns = spark.createDataFrame([(k, f"{k % 898 + 1 + (k % 898 + 1 >= 666):03d}-{k % 99 + 1:02d}-{k % 9999 + 1:04d}") for k in range(2000)], "doc_id long, text string")
    out = [r.text for r in pii.pseudonymised(ssns).collect()]
    assert len(set(out)) == 2000 and not any(x.startswith(("000", "666", "9")) or "-00-" in x or x.endswith("0000") for x in out)


def test_extra_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, "10.0.0.1", "a", "b", 3)], "doc_id long, text string, found string, `row` string, N_PII int")
    out = pii.pseudonymised(df, count=None)
    assert out.columns == df.columns and out.first().N_PII == 3 and out.first().text != "10.0.0.1"
    assert pii.pseudonymised(df).columns.count("n_pii") == 1
    assert pii.pseudonymised(df.limit(0)).count() == 0


def test_numbers_and_words_beside_cards_and_ibans(spark):
    card, iban = "4532015112830366", "AT61 1904 3002 3457 3201"
    cases = {
        f"{card} 12/27": 1, "4532-0151-1283-0366 09/28": 1, f"{card} 123": 1, f"12 {card}": 1, f"{card} 123 {card}": 2, f"{card} {card}": 2, f"{card} 078-05-1120": 2, f"{card} 10.1.2.255": 2,
        f"{iban} USD": 1, f"{iban} PAID NOW": 1, f"{iban}": 1, "4532015112830367 123": 0, "1 2 3 4 5 6 7 8 9 10 11 12 13": 0,
    }
    df = spark.createDataFrame([(k, f"x {t}.") for k, t in enumerate(cases)], "doc_id long, text string")
    out = {r.doc_id: r for r in pii.pseudonymised(df).collect()}
    for k, (t, n) in enumerate(cases.items()):
        new = out[k].text
        assert out[k].n_pii == n and (n or new == f"x {t}."), t
        assert not n or card not in new and "4532-0151-1283-0366" not in new and iban not in new, t
        assert re.sub("[0-9]", "9", new) == re.sub("[0-9]", "9", f"x {t}.") or "10.1" in t, t
    assert out[0].text.endswith(" 12/27.") and out[8].text.endswith(" USD.") and luhn_ok(out[0].text.split()[1])


def test_against_brute_force(spark):
    rnd = random.Random(14)
    number = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))

    def card():
        d = number(rnd.randint(12, 18))
        d += str(-brute.luhn(d + "0") % 10)
        return rnd.choice([d, " ".join(d[k : k + 4] for k in range(0, len(d), 4)), "-".join(d[k : k + 4] for k in range(0, len(d), 4)), d[:-1] + "0"])

    def iban():
        country, body = rnd.choice(["DE", "GB", "AT"]), rnd.choice(["", "WEST"]) + number(rnd.randint(12, 18))
        plain = f"{country}{98 - brute.modulo(body + country + '00'):02d}{body}"
        return rnd.choice([plain, " ".join(plain[k : k + 4] for k in range(0, len(plain), 4)), plain + "0"])

    def day():
        d = dt.date.fromordinal(rnd.choice([rnd.randint(1, 3652059), rnd.randint(690000, 770000)]))
        return rnd.choice([d.isoformat(), f"{d.month:02d}/{d.day:02d}/{d.year:04d}", f"{d.day:02d}/{d.month:02d}/{d.year:04d}", f"{d.day:02d}.{d.month:02d}.{d.year:04d}", "2023-02-30", "31/31/2020"])

    makers = [
        card, iban, day, lambda: f"{number(3)}-{number(2)}-{number(4)}", lambda: ".".join(str(rnd.randint(0, 260)) for _ in range(4)), lambda: f"+{rnd.randint(1, 99)} ({number(3)}) {number(3)}-{number(4)}",
        lambda: f"{number(3)}.{number(3)}.{number(4)}", lambda: rnd.choice(["a.b@Mail.example.com", "x_1@h-2.org", "no@host"]), lambda: "".join(rnd.choice("0123456789abcdef") for _ in range(rnd.randint(30, 70))).replace("a", "a"),
        lambda: number(rnd.randint(1, 22)), lambda: rnd.choice(["word", "\n", "USD", "é", ""]),
    ]
    texts = ["".join(rnd.choice(makers)() + rnd.choice([" ", " ", ", ", "-", "\n", ""]) for _ in range(rnd.randint(0, 8))) for _ in range(1500)]
    texts += [None, "", texts[3], texts[3], "no data " * 20000 + "4532015112830366 " + "x" * 100000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: (r.text, r.n_pii) for r in pii.pseudonymised(df).collect()}
    for k, t in enumerate(texts):
        assert out[k] == brute.pseudonymised(t), t
    assert sum(n for _, n in out.values()) > 1500


def test_dates_never_meet(spark):
    days = [dt.date(1988, 1, 1) + dt.timedelta(days=k) for k in range(4383)] + [dt.date(1899, 12, 31), dt.date(2100, 1, 1), dt.date(1, 1, 1), dt.date(9999, 12, 31)]
    given = sorted({form.format(d.year, d.month, d.day) for d in days for form in ("{0:04d}-{1:02d}-{2:02d}", "{1:02d}/{2:02d}/{0:04d}", "{2:02d}/{1:02d}/{0:04d}", "{2:02d}.{1:02d}.{0:04d}")})
    df = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")
    out = {r.doc_id: r.text for r in pii.pseudonymised(df).collect()}
    assert len(set(out.values())) == len(given) and sum(out[k] == t for k, t in enumerate(given)) < 5
    assert all(re.sub("[0-9]", "9", out[k]) == re.sub("[0-9]", "9", t) for k, t in enumerate(given))
