"""Place groups, kinds with their tag filters, score rules, name keys, venue kinds.

A filter is a list of clauses (key, op, value) that must all hold; a kind matches when any of its
filters does. Ops: = equal, ~ pattern found, !~ pattern not found, ? key present.
"""

from __future__ import annotations

GROUPS = {
    "play": ("Spillen", "Spielen", "Jouer", "Play"),
    "nature": ("Natur & Gréngs", "Natur & Grün", "Nature & Verdure", "Nature & Green"),
    "picnic": ("Picknick & Rascht", "Picknick & Rast", "Pique-nique & Repos", "Picnic & Rest"),
    "hike": ("Wanderen & Weeër", "Wandern & Wege", "Randonnée & Chemins", "Hiking & Trails"),
    "animals": ("Déieren & Bauerenhaff", "Tiere & Bauernhöfe", "Animaux & Fermes", "Animals & Farms"),
    "culture": ("Kultur & Léieren", "Kultur & Lernen", "Culture & Apprentissage", "Culture & Learning"),
    "sport": ("Sport & Schwammen", "Sport & Schwimmen", "Sport & Natation", "Sport & Swimming"),
}

# kind: (group, base score, (lb, de, fr, en) labels, filters as Overpass fragments, options)
KINDS: dict[str, tuple[str, int, tuple[str, str, str, str], list[str], dict]] = {
    "playground": ("play", 90, ("Spillplaz", "Spielplatz", "Aire de jeux", "Playground"),
                   ['["leisure"="playground"]'], {}),
    "swimming": ("sport", 85, ("Schwämm", "Schwimmbad / Freibad", "Piscine", "Swimming pool"),
                 ['["leisure"="swimming_pool"]', '["amenity"="public_bath"]', '["leisure"="water_park"]'],
                 {"require_name": True, "allow_customers": True}),
    "water_playground": ("play", 88, ("Waasserspillplaz", "Wasserspielplatz", "Aire de jeux d'eau",
                                      "Water playground"),
                         ['["playground"="splash_pad"]', '["leisure"="splash_pad"]', '["leisure"="water_park"]',
                          '["amenity"="fountain"]["drinking_water"="yes"]'], {}),
    "skatepark": ("play", 75, ("Skatepark / Pumptrack", "Skatepark / Pumptrack", "Skatepark / Pumptrack",
                               "Skatepark / Pumptrack"),
                  ['["leisure"="skatepark"]', '["leisure"="pitch"]["sport"="skateboard"]',
                   '["leisure"="pitch"]["sport"="cycling"]["cycling"="pumptrack"]'], {}),
    "indoor_play": ("play", 85, ("Indoor-Spillplaz", "Indoor-Spielplatz", "Aire de jeux couverte", "Indoor play"),
                    ['["leisure"="indoor_play"]', '["leisure"="adventure_park"]', '["attraction"="soft_play"]'], {}),
    "minigolf": ("play", 70, ("Minigolf", "Minigolf", "Mini-golf", "Mini golf"),
                 ['["leisure"="miniature_golf"]'], {}),
    "park": ("nature", 70, ("Park / Gaart", "Park / Garten", "Parc / Jardin", "Park / Garden"),
             ['["leisure"="park"]', '["leisure"="garden"]["access"!~"^(private|no|customers)$"]'], {}),
    "nature_reserve": ("nature", 60, ("Naturschutzgebitt", "Naturschutzgebiet", "Réserve naturelle",
                                      "Nature reserve"),
                       ['["leisure"="nature_reserve"]', '["boundary"="protected_area"]'], {}),
    "viewpoint": ("nature", 55, ("Aussiichtspunkt", "Aussichtspunkt", "Point de vue", "Viewpoint"),
                  ['["tourism"="viewpoint"]', '["man_made"="tower"]["tower:type"]'], {}),
    "water": ("nature", 80, ("Baden / Séi / Plage", "Baden / See / Strand", "Baignade / Lac / Plage",
                             "Bathing / Lake / Beach"),
              ['["leisure"="swimming_area"]', '["natural"="beach"]', '["sport"="swimming"]["natural"="water"]'], {}),
    "lake": ("nature", 85, ("Badeséi", "Badesee", "Lac de baignade", "Bathing lake"),
             ['["natural"="water"]["water"="lake"]'], {"require_name": True, "min_area_m2": 20_000}),
    "cave_rock": ("nature", 65, ("Buedem / Fiels", "Höhle / Fels", "Grotte / Rocher", "Cave / Rock"),
                  ['["natural"="cave_entrance"]', '["natural"="rock"]["name"]'], {}),
    "picnic": ("picnic", 82, ("Picknickplaz", "Picknickplatz", "Aire de pique-nique", "Picnic site"),
               ['["tourism"="picnic_site"]', '["leisure"="picnic_table"]'], {}),
    "bbq": ("picnic", 78, ("Grillplaz", "Grillplatz / Feuerstelle", "Barbecue / Foyer", "BBQ / Firepit"),
            ['["amenity"="bbq"]', '["leisure"="firepit"]'], {}),
    "shelter": ("picnic", 60, ("Schutzhaischen", "Schutzhütte", "Abri", "Shelter"),
                ['["amenity"="shelter"]["shelter_type"~"picnic_shelter|weather_shelter"]',
                 '["tourism"="wilderness_hut"]'], {}),
    "hiking_route": ("hike", 70, ("Wanderwee", "Wanderweg", "Sentier de randonnée", "Hiking route"),
                     ['["route"="hiking"]["type"="route"]', '["route"="foot"]["type"="route"]'],
                     {"relations_only": True}),
    "nature_trail": ("hike", 68, ("Naturléierwee", "Themenpfad / Naturlehrpfad", "Sentier didactique",
                                  "Nature trail"),
                     ['["information"="route_marker"]["hiking"="yes"]["name"]',
                      '["tourism"="information"]["information"="board"]["board_type"~"natur"]'], {}),
    "cycle_route": ("hike", 60, ("Vëlospiste", "Radweg", "Piste cyclable", "Cycle route"),
                    ['["route"="bicycle"]["type"="route"]'], {"relations_only": True}),
    "fitness_trail": ("hike", 55, ("Fitnessparcours", "Fitnessparcours", "Parcours fitness", "Fitness trail"),
                      ['["leisure"="fitness_station"]', '["route"="fitness_trail"]'], {}),
    "farm": ("animals", 88, ("Bauerenhaff", "Bauernhof / Hofladen", "Ferme / Vente à la ferme",
                             "Farm / Farm shop"),
             ['["tourism"="attraction"]["attraction"="animal"]', '["amenity"="animal_boarding"]',
              '["shop"="farm"]', '["tourism"="farm"]'], {}),
    "zoo": ("animals", 92, ("Zoo / Déierepark", "Zoo / Wildpark", "Zoo / Parc animalier", "Zoo / Wildlife park"),
            ['["tourism"="zoo"]'], {"require_name": True}),
    "horse": ("animals", 72, ("Päerdshaff", "Reiterhof / Ponys", "Centre équestre", "Horse riding"),
              ['["leisure"="horse_riding"]', '["sport"="equestrian"]'], {"require_name": True}),
    "museum": ("culture", 65, ("Musée", "Museum", "Musée", "Museum"), ['["tourism"="museum"]'], {}),
    "castle": ("culture", 78, ("Buerg / Schlass / Ruinn", "Burg / Schloss / Ruine", "Château / Ruine",
                               "Castle / Ruin"),
               ['["historic"="castle"]', '["historic"="fort"]', '["historic"="ruins"]'], {"require_name": True}),
    "library": ("culture", 60, ("Bibliothéik", "Bibliothek", "Bibliothèque", "Library"),
                ['["amenity"="library"]'], {}),
    "theatre_cinema": ("culture", 58, ("Theater / Kino", "Theater / Kino / Kulturzentrum", "Théâtre / Cinéma",
                                       "Theatre / Cinema"),
                       ['["amenity"="theatre"]', '["amenity"="cinema"]', '["amenity"="arts_centre"]'], {}),
    "science": ("culture", 80, ("Science Center", "Science Center / Sternwarte", "Centre scientifique",
                                "Science centre"),
                ['["tourism"="attraction"]["attraction"="science"]', '["man_made"="observatory"]'], {}),
    "ice_rink": ("sport", 75, ("Aisstadion", "Eislaufbahn", "Patinoire", "Ice rink"),
                 ['["leisure"="ice_rink"]'], {}),
    "climbing": ("sport", 70, ("Klammeren", "Klettern (Halle / Fels)", "Escalade", "Climbing"),
                 ['["sport"="climbing"]', '["leisure"="sports_centre"]["sport"="climbing"]'], {}),
    "bowling_etc": ("sport", 72, ("Bowling / Trampolinn", "Bowling / Trampolinpark", "Bowling / Trampoline",
                                  "Bowling / Trampoline"),
                    ['["leisure"="bowling_alley"]', '["leisure"="trampoline_park"]',
                     '["leisure"="amusement_arcade"]'], {}),
    "theme_park": ("sport", 95, ("Fräizäitpark", "Freizeitpark", "Parc d'attractions", "Theme park"),
                   ['["tourism"="theme_park"]'], {}),
}

# (tag, pattern or None for "present", points)
SCORE_RULES = [
    ("name", None, 5), ("website", None, 2), ("opening_hours", None, 2),
    ("wheelchair", r"^(yes|designated)$", 4), ("toilets", r"^yes$", 4), ("amenity", r"^toilets$", 4),
    ("drinking_water", r"^yes$", 3), ("shade", r"^(yes|partial)$", 3),
    ("fee", r"^no$", 3), ("fee", r"^yes$", -3), ("playground:theme", None, 3), ("max_age", None, 2),
    ("baby_feeding", r"^(yes|room|dedicated_room)$", 5), ("changing_table", r"^yes$", 5),
    ("access", r"^(private|no|customers)$", -40),
]

NAME_KEYS = ["name:lb", "name:de", "name:fr", "name", "official_name", "loc_name", "alt_name"]

AGE_DEFAULTS = {
    "playground": (1, 12), "water_playground": (1, 10), "skatepark": (6, 18), "indoor_play": (1, 12),
    "minigolf": (5, 99), "farm": (2, 12), "zoo": (2, 99), "horse": (4, 16), "theme_park": (3, 99),
    "swimming": (1, 99), "ice_rink": (4, 99), "climbing": (5, 99),
}

ROUTE_KINDS = ["hiking_route", "cycle_route"]
LAYERS = {"hiking": ["hiking_route", "nature_trail"], "cycling": ["cycle_route"]}

# (tag, value, label) in the order the kinds are worth having
VENUE_KINDS = [
    ("tourism", "museum", "Musée"), ("amenity", "arts_centre", "Kulturzentrum"), ("amenity", "theatre", "Theater"),
    ("amenity", "library", "Bibliothek"), ("amenity", "events_venue", "Veranstaltungsort"),
    ("amenity", "community_centre", "Gemeinschaftshaus"), ("amenity", "cinema", "Kino"),
    ("tourism", "gallery", "Galerie"), ("tourism", "zoo", "Tierpark"), ("tourism", "theme_park", "Freizeitpark"),
    ("tourism", "attraction", "Sehenswürdigkeit"), ("tourism", "information", "Tourist-Info"),
    ("historic", "castle", "Burg"), ("leisure", "sports_centre", "Sportzentrum"),
    ("leisure", "water_park", "Erlebnisbad"), ("leisure", "swimming_pool", "Schwimmbad"),
    ("leisure", "nature_reserve", "Naturschutzgebiet"),
]

VENUE_CATEGORIES = {
    "Musée": ["Culture", "Workshops"], "Kulturzentrum": ["Culture", "Workshops"], "Theater": ["Culture"],
    "Bibliothek": ["Culture", "Workshops"],
    "Veranstaltungsort": ["Culture", "Festivals"], "Gemeinschaftshaus": ["Culture", "Festivals"],
    "Kino": ["Culture"], "Galerie": ["Culture"], "Tierpark": ["Animals", "Nature"], "Freizeitpark": ["Festivals"],
    "Sehenswürdigkeit": ["Culture"], "Tourist-Info": ["Culture", "Festivals"], "Burg": ["Culture"],
    "Sportzentrum": ["Sports"], "Erlebnisbad": ["Sports"], "Schwimmbad": ["Sports"], "Naturschutzgebiet": ["Nature"],
}
