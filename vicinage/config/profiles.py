"""What onboarding answers mean for ranking, plans and request limits."""

INTEREST_CATEGORIES = {
    "playgrounds": ["Playgrounds"], "animals": ["Animals"], "nature": ["Nature"], "workshops": ["Workshops"],
    "culture_kids": ["Culture"], "culture": ["Culture"], "landmarks": ["Culture"], "festivals": ["Festivals"],
    "concerts": ["Festivals", "Culture"], "nightlife": ["Nightlife"], "fine_dining": ["FineDining", "Food"],
    "food": ["Food"], "wine": ["Wine", "Food"], "sports": ["Sports"], "wellness": ["Wellness"],
    "shopping": ["Shopping"],
}
NEED_FILTERS = {"wheelchair": "wheelchair", "sensory": "sensory", "free_parking": "free_parking"}
CHILD_AGE_GROUPS = ["0-3", "4-8", "9-14", "15+"]
BUDGET_LIMITS = {"free": 0.0, "cheap": 15.0, "medium": 30.0, "any": None}

POINTS = {"interest": 1.0, "age_group": 0.5, "home_canton": 3.0, "near_canton": 1.0, "far_canton": -0.5,
          "free_wanted": 1.0, "in_budget": 0.3, "over_budget": -0.5}

SLOTS, HOME_SLOTS, PER_CANTON = 8, 2, 4
TITLE_STOPWORDS = [
    "actualites", "actualite", "spectacle", "programm", "programme", "centre", "parc", "park", "castle",
    "chateau", "schloss", "musee", "the", "and", "der", "die", "das", "les", "des", "with", "loisirs",
    "activite", "activites", "event", "events",
]
TITLE_WORD_LENGTH = 5

# Sponsorship plans: days granted, price in cents. Request limits: (window, allowed).
PLANS = {"1month": (30, 4900), "3months": (90, 12900), "6months": (180, 22900)}
FEATURED_PRICE = 49
REQUEST_LIMITS = [("1 minute", 5), ("1 minute", 10), ("1 hour", 10), ("1 hour", 60)]
