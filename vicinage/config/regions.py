"""Cantons, their neighbours and centres, region hints, town aliases, curated mappings."""

NEIGHBOURS = {
    "Luxembourg": ["Mersch", "Capellen", "Esch-sur-Alzette", "Grevenmacher", "Remich"],
    "Esch-sur-Alzette": ["Luxembourg", "Capellen"],
    "Capellen": ["Luxembourg", "Esch-sur-Alzette", "Mersch", "Redange"],
    "Mersch": ["Luxembourg", "Capellen", "Redange", "Diekirch"],
    "Redange": ["Capellen", "Mersch", "Wiltz"],
    "Diekirch": ["Mersch", "Wiltz", "Clervaux", "Vianden", "Echternach", "Grevenmacher"],
    "Vianden": ["Diekirch", "Clervaux"],
    "Wiltz": ["Redange", "Diekirch", "Clervaux"],
    "Clervaux": ["Wiltz", "Diekirch", "Vianden"],
    "Echternach": ["Diekirch", "Grevenmacher"],
    "Grevenmacher": ["Diekirch", "Echternach", "Remich", "Luxembourg"],
    "Remich": ["Grevenmacher", "Luxembourg"],
}

CANTON_CENTRES = {
    "Luxembourg": (49.6117, 6.1319), "Esch-sur-Alzette": (49.4959, 5.9807), "Diekirch": (49.8683, 6.1560),
    "Clervaux": (50.0546, 6.0289), "Wiltz": (49.9663, 5.9333), "Vianden": (49.9333, 6.2036),
    "Echternach": (49.7217, 6.4225), "Grevenmacher": (49.6800, 6.4400), "Remich": (49.5453, 6.3667),
    "Mersch": (49.7500, 6.1067), "Capellen": (49.6461, 5.9906), "Redange": (49.7639, 5.8850),
}
COUNTRY_CENTRE = (49.61, 6.13)
SOURCE_CENTRE = (49.6116, 6.1319)
PLACEHOLDER_CENTRE = (49.8153, 6.1296)
DEFAULT_CANTON = DEFAULT_TOWN = "Luxembourg"

CANTON_NAMES = {
    "Capellen": "Capellen", "Clervaux": "Clervaux", "Clerf": "Clervaux", "Diekirch": "Diekirch",
    "Echternach": "Echternach", "Esch-sur-Alzette": "Esch-sur-Alzette", "Esch-Uelzecht": "Esch-sur-Alzette",
    "Grevenmacher": "Grevenmacher", "Luxembourg": "Luxembourg", "Luxemburg": "Luxembourg",
    "Lëtzebuerg": "Luxembourg", "Mersch": "Mersch", "Redange": "Redange", "Redingen": "Redange",
    "Remich": "Remich", "Vianden": "Vianden", "Wiltz": "Wiltz",
}

# Folded short forms of a town, and those only the canton can settle.
TOWN_ALIASES = {"lux": "Luxembourg", "luxbg": "Luxembourg"}
AMBIGUOUS_TOWNS = {"esch": {"eschsuralzette": "Esch-sur-Alzette", "wiltz": "Esch-sur-Sûre"}}
MIN_SPELLING = 5

REGION_CANTON = {
    "Luxembourg City": "Luxembourg", "Guttland": "Mersch", "Minett": "Esch-sur-Alzette",
    "Mullerthal": "Echternach", "Moselle": "Grevenmacher", "Éislek": "Wiltz", "Landesweit": "Luxembourg",
}
# Name fragments of a source, first hit decides.
CANTON_FRAGMENTS = [
    ("eislek", "Wiltz"), ("éislek", "Wiltz"), ("eislëk", "Wiltz"), ("minett", "Esch-sur-Alzette"),
    ("moselle", "Grevenmacher"), ("mullerthal", "Echternach"), ("ville de luxembourg", "Luxembourg"),
    ("vdl", "Luxembourg"), ("spillplaz", "Luxembourg"),
]

CURATED_CATEGORIES = {
    "playground": ["Playgrounds"], "indoor_playground": ["Playgrounds", "Indoor"], "hiking": ["Nature"],
    "water": ["Nature", "Sports"], "culture": ["Culture"], "animals": ["Animals"],
    "adventure": ["Sports", "Nature"], "sports": ["Sports"],
}
CURATED_TYPES = {"indoor": "Indoor", "outdoor": "Outdoor", "both": "Outdoor"}

# Spellings of a commune a boundary record may publish.
SPELLING_TAGS = ["name", "name:de", "name:fr", "name:lb", "official_name"]
