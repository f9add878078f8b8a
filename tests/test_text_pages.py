"""Permit card limits, byte spans, report/leaderboard text, page extraction."""

from pyspark.sql import functions as F

from trenchline.functions import text as tx
from trenchline.operators import cards, pages


def test_card_text_matches_reference_rules(spark):
    cases = [
        ("1 N MAIN ST, Chicago, IL", "PARKWAY,STREET", "123", True, None),
        ("1 N MAIN ST, Chicago, IL", "General Construction", "124", False, "short place"),
        ("1 N MAIN ST, Chicago, IL", "General Construction", "125", True, "é" * 400),
        ("9" * 150 + " N MAIN ST, Chicago, IL", "X" * 50, "126", True, "far too long location"),
        ("1 N 🚧 ST, Chicago, IL", "W", "127", False, "🚧" * 10),
    ]
    df = spark.createDataFrame(cases, "address string, work_type string, dig_ticket_number string, is_emergency boolean, location string")
    locs = df.select("dig_ticket_number", "location")
    got = {r.dig_ticket_number: r for r in cards.card_texts(df.drop("location"), locs).collect()}
    # fixed values: the wording of the posts
    head = "🎲 Hole Roulette!\n\nHere's a permit with a Dig Date yesterday\n\n"
    want = {
        "123": head + "📍 1 N MAIN ST, Chicago, IL\n🔧 PARKWAY,STREET\n📝 Permit #123\n🚨 Emergency Work",
        "124": head + "📍 1 N MAIN ST, Chicago, IL\n🔧 General Construction\n🚧 Location of Dig: short place\n📝 Permit #124",
        "125": head + "📍 1 N MAIN ST, Chicago, IL\n🔧 General Construction\n🚧 Location of Dig: " + "é" * 136 + "...\n📝 Permit #125\n🚨 Emergency Work",
        "126": head + "📍 " + "9" * 150 + " N MAIN ST, Chicago, IL\n🔧 " + "X" * 50 + "\n📝 Permit #126\n🚨 Emergency Work",
        "127": head + "📍 1 N 🚧 ST, Chicago, IL\n🔧 W\n🚧 Location of Dig: 🚧🚧🚧🚧🚧🚧🚧🚧🚧🚧\n📝 Permit #127",
    }
    assert len(want["125"]) == 300
    for ticket, text in want.items():
        r = got[ticket]
        start = text.encode().index(f"#{ticket}".encode())
        assert (r.text, r.byte_start, r.byte_end) == (text, start, start + 4)


def test_work_type_and_address(spark):
    df = spark.createDataFrame(
        [(" A_B ", 10, "N", "MAIN", None), (None, 11, "S", "ELM", "AVE"), ("  ", None, "E", "OAK", "ST")],
        "dig_location string, street_number_from bigint, street_direction string, street_name string, street_suffix string",
    ).withColumn("dig_ticket_number", F.lit("t")).withColumn("is_emergency", F.lit(False))
    got = cards.permit_cards(df).collect()
    assert [r.work_type for r in got] == ["A,B", "General Construction", "General Construction"]
    assert [r.address for r in got] == ["10 N MAIN, Chicago, IL", "11 S ELM AVE, Chicago, IL", "E OAK ST, Chicago, IL"]


def test_leaderboard_text(spark):
    rows = [("2024-01-01", i, f"N{i}", 10 - i) for i in range(1, 6)]
    df = spark.createDataFrame(rows, "day string, rank int, name string, count bigint")
    text = cards.leaderboard_texts(df).first().text
    marks = tx.RANK_MARKS + [tx.OTHER_MARK, tx.OTHER_MARK]
    assert text == tx.LEADERBOARD_TITLE + "".join(f"{marks[i - 1]} N{i}: {10 - i}\n" for i in range(1, 6))


def test_page_label_value(spark):
    html = (
        '<html><head><title>Ticket A &amp; B</title></head><body>'
        '<div class="row"><label class="x">Requested by</label><div class="col-sm-8">Somebody</div></div>'
        '<div class="row"><label class="control-label">Location of Dig</label>\n'
        '<div class="col-sm-8"> FRONT &amp; <b>REAR</b> PARKWAY\n</div></div></body></html>'
    )
    df = spark.createDataFrame([(1, "u", html), (2, "v", "<html><title> x </title></html>")], "page_id bigint, url string, html string")
    got = {r.page_id: r for r in pages.page_fields(df).collect()}
    assert got[1].location_of_dig == "FRONT & REAR PARKWAY"
    assert got[1].title == "Ticket A & B"
    assert got[2].location_of_dig is None and got[2].title == "x"


def test_page_label_stays_in_its_row(spark):
    def row(label, value, quote='"'):
        return f"<div class={quote}row{quote}><label>{label}</label><div class={quote}col-sm-8{quote}>{value}</div></div>"

    other = row("Requested by", "JOHN 555-1234")
    htmls = [
        '<div class="row"><label>Location of Dig</label></div>' + other,  # no value: not the next row's
        row("<b>Location of Dig</b>", "A"),
        row("Location of Dig", "B", "'") + other,
        row("Location of Dig", "C <div>D</div> E") + other,
    ]
    df = spark.createDataFrame(list(enumerate(htmls)), "page_id long, html string").withColumn("url", F.lit("u"))
    got = {r.page_id: r.location_of_dig for r in pages.page_fields(df).collect()}
    assert got == {0: None, 1: "A", 2: "B", 3: "C D E"}
