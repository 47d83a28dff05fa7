"""What texts state: ages, prices, categories, safety, titles, towns."""

from pyspark.sql import functions as F

from vicinage.functions import hints, text as tx
from vicinage.operators import towns


def t():
    return F.col("t")


def test_ages(ask):
    cases = {
        "vun 4 bis 10 Joer": (4, 10, "event"), "de 2 à 5 ans": (2, 5, "event"), "6-12 Jahre": (6, 12, "event"),
        "ab 6 Joer": (6, None, "event"), "à partir de 12 ans": (12, None, "event"), "jusqu'à 10 ans": (None, 10, "event"),
        "50 Joer Guiden a Scouten": (None, None, "unknown"), "zënter 20 Joer": (None, None, "unknown"), "ab 18:30": (None, None, "unknown"),
        "vun 40 bis 10 Joer": (None, None, "unknown"), "": (None, None, "unknown"), "25 ans anniversaire, dès 3 ans": (3, None, "event"),
        "AB 6 JOER": (6, None, "event"), "À PARTIR DE 8 ANS": (8, None, "event"),
    }
    got = ask(list(cases), "t string", hints.read_age(t()))
    assert [tuple(g) for g in got] == list(cases.values())


def test_prices(ask):
    cases = {
        "Entrée gratuite": (0.0, True), "Eintritt frei, Workshop 30 €": (0.0, True), "08h30: Gratis Fairtrade-Frühstück": (None, False),
        "Tickets 12,50 €": (12.5, False), "€ 7": (7.0, False), "EUR 15.5 pro Persoun": (15.5, False), "2026": (None, False),
        "Preisgeld 500 €, Eintritt 8 €": (None, False), "Preisgeld 500 € " + "x" * 80 + " Eintritt 8 €": (8.0, False),
        "1234 €": (None, False), "0 €": (None, False), "Spende 5 €": (None, False), "5 € Umsatz": (None, False),
        "600 € oder 20 Euro": (20.0, False), "FRÄIEN ENTRÉE": (0.0, True),
    }
    got = ask(list(cases), "t string", hints.read_price(t()))
    assert {t: (g["adult"], g["is_free"]) for t, g in zip(cases, got)} == cases


def test_safety_keeps_innocent_words(ask):
    innocent = ["Sextett am Park", "Kartoffelpuffer", "Hardcore-Punk", "Ford Escort", "XXX. Editioun", "Nacktschnecke", "Comic-Strip", "Sauna", "Essex"]
    refused = ["Striptease", "CLUB ÉCHANGISTE", "strip club", "Erotikmesse", "escort-service", "xxx-film", "Soirée libertine", "pole dance show"]
    got = ask(innocent + refused, "t string", hints.assess(t()))
    assert [g is None for g in got] == [True] * len(innocent) + [False] * len(refused)


def test_categories(ask):
    cases = [("Kannermoien um Spillplaz", ["Culture"], ["Playgrounds"]), ("Fête um Spillplaz", ["Culture"], ["Playgrounds", "Festivals"]),
             ("Konzert", ["Animals", "Nature"], ["Animals", "Nature"]), ("atelier de réparation", ["Culture"], ["Culture"]),
             ("Atelier Keramik am Zoo", ["Festivals"], ["Animals", "Workshops"]), ("", ["Festivals"], ["Festivals"])]
    got = ask([(a, b) for a, b, _ in cases], "t string, d array<string>", hints.categorise(t(), F.col("d")))
    assert got == [c for _, _, c in cases]


def test_titles(ask):
    cases = [("Journée - Commune de Leudelange", "X", "Journée"), ("Plogging – Pick up and run", "X", "Plogging – Pick up and run"),
             ("Trikot Party – Handball Käerjeng", "Käerjeng", "Trikot Party – Handball Käerjeng"),
             ("Archives des Actualités - Käerjeng", "Käerjeng", "Archives des Actualités"), ("Commune de X", "X", "Commune de X"), ("Fest | GEMENG RÉISER", "X", "Fest")]
    got = ask([(a, b) for a, b, _ in cases], "t string, s string", tx.strip_site_tail(t(), F.col("s")))
    assert got == [c for _, _, c in cases]


def test_entities(ask):
    texts = ["Fit &#038; Fun &#8211; Zumba", "&eacute;t&eacute; &copy &amp;lt;", "&#x1F600; &#128; &#0; &unknown; AT&T", "nix", None]
    import html

    want = [html.unescape(t) if t is not None else None for t in texts]
    assert ask(texts, "t string", tx.unescape_html(t())) == want


def test_fold_and_slug(ask):
    assert ask(["Péiteng", "Esch-sur-Sûre", "Ǆ 1"], "t string", tx.fold(t()))[:2] == ["peiteng", "eschsursure"]
    assert ask(["  Été / Spiel! ", "…", None], "t string", tx.slugify(t())) == ["ete-spiel", "poi", "poi"]


def test_town_names(spark):
    communes = spark.createDataFrame([
        (1, "Esch-sur-Alzette", ["Esch-Uelzecht"], "Esch-sur-Alzette", 49.5, 5.98), (2, "Esch-sur-Sûre", ["Esch-Sauer"], "Wiltz", 49.9, 5.9),
        (3, "Luxembourg", ["Luxembourg", "Lëtzebuerg"], "Luxembourg", 49.6, 6.1), (4, "Bech", [], "Echternach", 49.7, 6.3),
        (5, "Reckange-sur-Mess", ["Reckange-sur-Mess", "Reckingen/Mess"], "Esch-sur-Alzette", 49.5, 6.0)],
        "commune_id int, name string, names array<string>, canton string, lat double, lng double")
    rows = spark.createDataFrame([(1, "esch uelzecht", None), (2, "Esch", "Wiltz"), (3, "Esch", "Nowhere"), (4, "Lëtzebuerg-Stad", None), (5, "Kirchberg", None),
                                  (6, "  ", None), (7, "Belval Centre", None)], "id int, town string, canton string")
    got = {r.id: r.town_canonical for r in towns.canonical_towns(rows, communes, canton="canton").collect()}
    assert got == {1: "Esch-sur-Alzette", 2: "Esch-sur-Sûre", 3: "Esch", 4: "Luxembourg", 5: "Kirchberg", 6: "", 7: "Belval Centre"}
    texts = spark.createDataFrame([(1, "Esch sur Sure und Obersauerstausee"), (2, "Bech an Dall"), (3, "")], "id int, t string")
    assert {r.id: r.town for r in towns.towns_in_text(texts, communes, "id", "t").collect()} == {1: "Esch-sur-Sûre"}
    names = spark.createDataFrame([("Reckingen",), ("Esch",), ("Luxembourg",), ("xx",)], "name string")
    # "Esch" is contained in two communes, so it is nobody; short names take the same way.
    assert {r.name: r.commune for r in towns.match_commune(names, communes).collect()} == {
        "Reckingen": "Reckange-sur-Mess", "Esch": None, "Luxembourg": "Luxembourg", "xx": None}
