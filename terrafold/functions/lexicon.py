"""Word lists and class tables that results depend on."""

from __future__ import annotations

# Canonical remote-sensing terms, in order.
CANONICAL = [
    "building", "roof", "road", "tree", "vegetation", "grass", "bare ground", "farmland", "vehicle", "parking lot",
    "water", "bridge", "fence", "wall", "ship", "harbor", "runway", "terrain", "shadow",
]

# Terms that never name a class.
STOP = ["a", "an", "area", "areas", "background", "image", "landscape", "object", "objects", "region", "remote sensing image", "scene", "view"]

# Stop terms of open captions.
CLEAN_STOP = [
    "a", "an", "and", "area", "areas", "background", "image", "images", "landscape", "object", "objects", "region", "regions",
    "scene", "scenery", "thing", "things", "view", "visible", "uav image", "remote sensing image",
]

# Synonyms.
SYNONYMS = {
    "airport runway": "runway", "asphalt": "road", "asphalt road": "road", "bare land": "bare ground", "bare soil": "bare ground",
    "bareland": "bare ground", "barren": "bare ground", "barren land": "bare ground", "bus": "vehicle", "buses": "vehicle",
    "car": "vehicle", "cars": "vehicle", "concrete pavement": "road", "crop": "farmland", "cropland": "farmland",
    "field": "farmland", "fields": "farmland", "forest": "tree", "greenery": "vegetation", "harbour": "harbor",
    "house": "building", "houses": "building", "lane": "road", "lawn": "grass", "pavement": "road", "parking": "parking lot",
    "parking area": "parking lot", "parking lots": "parking lot", "river": "water", "roads": "road", "roofs": "roof",
    "runways": "runway", "sea": "water", "ships": "ship", "soil": "bare ground", "street": "road", "streets": "road",
    "truck": "vehicle", "trucks": "vehicle", "vehicles": "vehicle", "woodland": "tree",
}

# Plurals.
PLURALS = {
    "buildings": "building", "bridges": "bridge", "fences": "fence", "harbors": "harbor", "roads": "road", "roofs": "roof",
    "ships": "ship", "trees": "tree", "vehicles": "vehicle", "walls": "wall",
}

# The official classes.
OFFICIAL = {
    1: "roof", 2: "dirt motor road", 3: "paved motor road", 4: "river", 5: "pool", 6: "bridge", 9: "container", 10: "airstrip",
    11: "traffic barrier", 13: "green field", 14: "wild field", 15: "solar board", 16: "umbrella", 17: "transparent roof",
    18: "car park", 19: "paved walk", 20: "sedan", 24: "truck",
}

# Aliases of the official classes.
RULE_ALIASES = {
    1: ["roof", "rooftop", "building roof", "house roof"],
    2: ["dirt road", "unpaved road", "soil road", "gravel road", "earth road"],
    3: ["road", "paved road", "asphalt road", "motor road", "street", "road surface"],
    4: ["river", "stream", "waterway", "river channel"],
    5: ["pool", "swimming pool", "water pool"],
    6: ["bridge", "overpass"],
    9: ["container", "shipping container", "storage container", "freight container"],
    10: ["airstrip", "runway", "airport runway", "landing strip"],
    11: ["traffic barrier", "road barrier", "concrete barrier", "road divider"],
    13: ["green field", "grass", "lawn", "farmland", "crop field", "cropland"],
    14: ["wild field", "vegetation", "tree", "forest", "shrub", "grassland"],
    15: ["solar board", "solar panel", "photovoltaic panel", "solar array"],
    16: ["umbrella", "parasol"],
    17: ["transparent roof", "glass roof", "translucent roof"],
    18: ["car park", "parking lot", "parking area"],
    19: ["paved walk", "sidewalk", "walkway", "footpath", "pedestrian path"],
    20: ["sedan", "car", "passenger car", "automobile", "vehicle"],
    24: ["truck", "lorry", "cargo truck", "large vehicle"],
}

# Groups of classes that are easily confused.
AMBIGUITY = {
    1: "roof", 17: "roof", 2: "surface", 3: "surface", 10: "surface", 18: "surface", 19: "surface", 4: "water", 5: "water",
    13: "field", 14: "field", 20: "vehicle", 24: "vehicle", 6: "bridge", 9: "container", 11: "barrier", 15: "solar", 16: "umbrella",
}

# Terms that count as hits for a ground-truth term.
GT_EXPANSION = {
    "building": ["building", "roof"], "road": ["road", "parking lot", "runway"], "vegetation": ["vegetation", "tree", "grass", "farmland"],
    "tree": ["tree", "vegetation"], "bare ground": ["bare ground", "terrain"], "vehicle": ["vehicle"], "water": ["water"],
    "wall": ["wall", "fence"], "fence": ["wall", "fence"],
}

# Coarse families, first match wins.
FAMILIES = {
    "background": ["background", "clutter", "void"],
    "vegetation": ["vegetation", "tree", "forest", "agricultural", "farmland", "cropland"],
    "grass": ["grass", "lawn"],
    "road": ["road", "pavement", "sidewalk", "parking lot", "airport surface", "airport runway", "roundabout", "ground track field", "tennis court", "basketball court"],
    "bare ground": ["bare ground", "bareland", "barren", "soil", "terrain", "hillside", "mountain"],
    "building": ["building", "house", "roof", "facade"],
    "vehicle": ["vehicle", "car", "truck", "bus", "large vehicle", "small vehicle", "motorcycle", "bicycle"],
    "water": ["water", "river", "sea", "swimming pool"],
    "wall/fence": ["wall/fence", "wall", "fence", "pole"],
    "object": ["person", "human", "rider", "ship", "harbor", "harbor/ship", "plane", "helicopter"],
    "shadow": ["shadow", "sky"],
}

# Open terms and the official class they stand for.
TERM_CLASSES = {
    "roof": 1, "building": 1, "house": 1, "building roof": 1, "dirt road": 2, "unpaved road": 2, "soil road": 2, "bare ground": 2, "soil": 2,
    "barren land": 2, "road": 3, "paved road": 3, "asphalt road": 3, "concrete pavement": 3, "concrete road": 3, "river": 4, "water": 4, "pool": 5,
    "swimming pool": 5, "bridge": 6, "container": 9, "airstrip": 10, "airport runway": 10, "airport surface": 10, "traffic barrier": 11, "barrier": 11,
    "grass": 13, "green field": 13, "lawn": 13, "farmland": 13, "cropland": 13, "vegetation": 14, "tree": 14, "forest": 14, "wild field": 14,
    "solar panel": 15, "solar board": 15, "umbrella": 16, "transparent roof": 17, "parking lot": 18, "car park": 18, "paved walk": 19, "sidewalk": 19,
    "walkway": 19, "vehicle": 20, "car": 20, "sedan": 20, "truck": 24, "large vehicle": 24,
}

# Prompts of terms.
PROMPT_GROUPS = {
    "building": ["building", "roof", "house"], "roof": ["roof", "building roof"], "road": ["road", "paved road", "asphalt road", "concrete pavement"],
    "paved road": ["paved road", "asphalt road", "concrete road"], "dirt road": ["dirt road", "unpaved road", "soil road"],
    "bare ground": ["bare ground", "soil", "barren land"], "soil": ["soil", "bare ground"], "tree": ["tree", "forest", "vegetation"],
    "vegetation": ["vegetation", "tree", "forest"], "grass": ["grass", "green field", "lawn"], "farmland": ["farmland", "cropland", "green field"],
    "parking lot": ["parking lot", "car park"], "vehicle": ["vehicle", "car", "truck"], "car": ["car", "sedan", "vehicle"], "truck": ["truck", "large vehicle"],
    "water": ["water", "river"], "river": ["river", "water"], "pool": ["pool", "swimming pool", "water"], "bridge": ["bridge"], "container": ["container"],
    "traffic barrier": ["traffic barrier", "barrier"], "airport runway": ["airport runway", "airstrip", "airport surface"],
    "airstrip": ["airstrip", "airport runway"], "solar panel": ["solar panel", "solar board"], "solar board": ["solar board", "solar panel"],
    "umbrella": ["umbrella"], "transparent roof": ["transparent roof"], "sidewalk": ["sidewalk", "paved walk", "walkway"],
    "paved walk": ["paved walk", "sidewalk", "walkway"],
}

# Tags of a frame without usable ones, and tags that every frame gets last.
FALLBACK_TAGS = ["building", "roof", "road", "vegetation", "grass", "bare ground", "vehicle", "parking lot"]
CORE_TAGS = [
    "roof", "building", "road", "paved road", "dirt road", "bare ground", "vegetation", "tree", "grass", "farmland", "parking lot", "water", "river", "pool",
    "bridge", "container", "airstrip", "airport runway", "traffic barrier", "solar panel", "solar board", "umbrella", "transparent roof", "sidewalk",
    "paved walk", "vehicle", "car", "truck",
]
