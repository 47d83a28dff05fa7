"""The word lists behind safety, category, age and price reading."""

# Content that is refused. Several words are absent on purpose: they live inside innocent ones.
EXPLICIT = [
    r"porno\w*", r"pornogra\w+", r"pornhub",
    r"erotik(?:film|kino|messe|shop|markt|show)\w*",
    r"salon[- ]?[ée]rotique", r"foire[- ]?[ée]rotique",
    r"sex[- ]?(?:shop|kino|club|party|partys|parties|messe|arbeit|kaufen)",
    r"sexuelle dienstleistung\w*",
    r"strip[- ]?club\w*", r"stripclub\w*", r"strip[- ]?tease\w*", r"striptease\w*",
    r"table[- ]?dance", r"lap[- ]?dance", r"pole[- ]?dance[- ]?show",
    r"bordell\w*", r"brothel\w*", r"maison[- ]close", r"laufhaus",
    r"eros[- ]?center", r"rotlicht\w*", r"red[- ]?light[- ]?district",
    r"escort[- ]?(?:service|agentur|agency|girl|boy)", r"callgirl\w*", r"callboy\w*",
    r"swingerclub\w*", r"swinger[- ]club\w*", r"club[- ]?[ée]changiste",
    r"fetisch[- ]?(?:party|club|markt|messe)", r"fetish[- ]?(?:party|club|market)",
    r"bdsm", r"sm[- ]?studio", r"dominastudio",
    r"nackt(?:bar|club|tanz|party)\w*", r"nudisten?\w*", r"fkk[- ]?(?:club|party)",
    r"peep[- ]?show\w*", r"burlesque[- ]?(?:show|night|revue)",
    r"xxx[- ]?(?:film|kino|movie|cinema)\w*", r"pornokino\w*",
    r"onlyfans",
    r"club[- ]libertin\w*", r"soir[ée]e[- ]libertine", r"partouze\w*",
    r"maison de passe", r"salon de massage [ée]rotique", r"erotikmassage\w*",
    r"prostitu\w+", r"prostitutie", r"freudenhaus\w*",
    r"saunaclub\w*", r"sauna[- ]club\w*",
    r"animierbar\w*", r"nachtbar\w*", r"bumslokal\w*",
    r"begleitservice\w*", r"hostessen[- ]?(?:service|agentur)",
    r"modelwohnung\w*", r"terminwohnung\w*",
    r"gogo[- ]?bar\w*", r"go[- ]go[- ]bar\w*",
    r"adult[- ]shop\w*", r"erotikshop\w*", r"erotic[- ]shop\w*",
    r"bordeel\w*", r"seksclub\w*",
]

# Innocent compounds, taken out of the text before the list above is applied.
ALLOWED = [
    r"sextett\w*", r"sextet\w*", r"sexta\b", r"sextant\w*",
    r"\w*essex\b", r"middlesex", r"sussex", r"wessex",
    r"nacktschnecke\w*", r"nacktsamer\w*", r"nacktmull\w*",
    r"comic[- ]?strip\w*", r"strip[- ]?art\w*", r"filmstrip\w*",
    r"stripe\w*", r"streifen\w*",
]

# The categories a reader can filter on, and the words that signal each.
CATEGORIES = ["Animals", "Culture", "Playgrounds", "Water", "Nature", "Workshops", "Festivals"]
CATEGORY_SIGNALS = {
    "Workshops": (
        r"workshop|atelier(?!s? de r[ée]paration)|coursen?\b|kachcours|"
        r"kurs\b|kursus|stage\s+(?:d'|de\s)|formatioun|initiation"
    ),
    "Festivals": (
        r"f[eê]te|festival|kirmes|kiermes|fouer|foire|braderie|"
        r"maart\b|march[ée]\b|market\b|floumoart|brocante|"
        r"duerffest|dorffest|schueberfouer|karneval|kavalkad|f[ée]st\b"
    ),
    "Animals": (
        r"d[ée]ierepark|tierpark|zoo\b|ferme p[ée]dagogique|"
        r"bauerenhaff|streichelzoo|aquarium|volière|päerd|chevaux"
    ),
    "Water": (
        r"schwamm|piscine|swimming|baden\b|bued\b|"
        r"plage\b|strand\b|kayak|kanu|cano[eë]|stand[- ]?up[- ]?paddle|pedalo"
    ),
    "Nature": (
        r"wanderung|randonn[ée]e|naturpad|naturlehrpfad|bësch\b|forêt|"
        r"jardin|gaart\b|arboretum|botanique|vogelkundlech|"
        r"promenade guid[ée]e|geführte wanderung|naturschutz"
    ),
    "Playgrounds": (
        r"spillplaz|spielplatz|aire de jeux|playground|"
        r"spillfest|kannerspillplaz"
    ),
    "Culture": (
        r"konzert|concert|musek\b|musique\b|theater|théâtre|spectacle|"
        r"exposition|ausstellung|vernissage|mus[ée]e|kino|cinéma|"
        r"lesung|conf[ée]rence|opér|ballet"
    ),
}
CATEGORY_ORDER = ["Playgrounds", "Animals", "Water", "Workshops", "Festivals", "Nature", "Culture"]
CATEGORY_FALLBACK = ["Culture"]
GENERIC_CATEGORIES = ["Culture", "Festivals"]

# Ages.
YEARS = r"(?:joer|jahren?|jahre|ans|années?|years?|yrs?)"
AGE_RANGE = (
    rf"(?:vun|von|de|from|entre)\s*(\d{{1,2}})\s*(?:bis|à|a|to|-|–|et)\s*(\d{{1,2}})\s*{YEARS}"
    rf"|(?<!\d)(\d{{1,2}})\s*[-–]\s*(\d{{1,2}})\s*{YEARS}"
)
AGE_FROM = rf"(?:ab|vun|von|from|à partir de|a partir de|dès)\s*(\d{{1,2}})\s*{YEARS}"
AGE_UP_TO = rf"(?:bis|jusqu'?[aà]|up to|max\.?)\s*(\d{{1,2}})\s*{YEARS}"
NOT_AN_AGE = (
    rf"(?:s?[ei]t|zënter|depuis|since)\s*\d{{1,3}}\s*{YEARS}"
    rf"|\d{{1,3}}\s*{YEARS}\s*(?:jubil\w*|bestoen|partnerschaft|anniversaire"
    rf"|guiden|scouten|verein|club|gemeng|commune|du\s+club)"
)

# Prices.
FREE_ADMISSION = (
    r"(?:"
    r"entr[ée]e?\s+(?:est\s+)?(?:libre|gratuite?|entièrement gratuite)"
    r"|fr[äa]ien?\s+entr[ée]e?"
    r"|eintritt\s+(?:ist\s+)?(?:frei|kostenlos|gratis)"
    r"|freier\s+eintritt"
    r"|admission\s+(?:is\s+)?free"
    r"|free\s+(?:entry|admission)"
    r"|entr[ée]e?\s*:\s*(?:gratuit|frei|free|0\s*€)"
    r"|participatioun\s+gratis"
    r")"
)
AMOUNT = (
    r"(?<!\d)(\d{1,3})(?:[.,](\d{1,2}))?\s*(?:€|EUR\b|Euro\b)"
    r"|(?:€|EUR\b)\s*(\d{1,3})(?:[.,](\d{1,2}))?(?!\d)"
)
NOT_A_FEE = (
    r"(?:preisgeld|prizemoney|prix\s+de\s+\d|gewinn|dotéiert|dotiert"
    r"|spende|don\s+libre|freiwëlleg|budget|umsatz|chiffre d'affaires)"
)
FEE_CONTEXT = (60, 30)
MAX_FEE = 500
FREE_LABEL, UNKNOWN_PRICE_LABEL = "Free entry", "Price not stated"
