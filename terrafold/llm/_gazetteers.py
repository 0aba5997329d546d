"""Word lists of the personal-data labelers. Fixed values, plain lists from common knowledge."""

from __future__ import annotations

GIVEN = frozenset(
    """
    Aaron Adam Ahmed Alberto Alejandro Alexander Alice Amanda Amelia Amy Andrea Andreas Andrew Angela Anna Anne Antoine Antonio
    Barbara Beatriz Benjamin Bernd Brian Camille Carla Carlos Carmen Caroline Catherine Charles Charlotte Chloe Christian Christine
    Christopher Claire Claudia Daniel David Diana Diego Dorothy Edward Elena Elizabeth Emily Emma Eric Fatima Felix Fernando
    Florian Frances Francisco Frank Gabriel George Greta Hannah Hans Heinrich Helen Helga Henry Ingrid Isabel Jack Jacob James Jana
    Jane Javier Jean Jennifer Jessica Joan John Jonas Jorge Joseph Juan Julia Julien Karen Karl Katharina Kevin Klaus Laura
    Linda Lisa Louis Lucia Lukas Manuel Margaret Maria Marie Mark Markus Martin Martina Mary Matthew Michael Michelle Miguel
    Mohammed Monika Nancy Nicolas Nicole Nina Oliver Olivia Pablo Patricia Patrick Paul Pedro Peter Petra Philip Pierre Rachel
    Raquel Rebecca Richard Robert Rosa Ruth Samuel Sandra Sarah Sebastian Sofia Sophie Stefan Stephen Susan Sylvie Teresa Thomas
    Ursula Valentina Victoria Walter William Wolfgang Yves
    """.split()
)

SURNAMES = frozenset(
    """
    Adams Alonso Alvarez Anderson Bailey Baker Bauer Becker Bell Bernard Bertrand Bonnet Braun Brown Campbell Carter Castillo Chen Clark Cohen
    Collins Cooper Cruz Davies Davis Delgado Diaz Dubois Durand Edwards Evans Fernandez Fischer Fontaine Fournier Garcia Garnier
    Girard Gomez Gonzalez Green Gutierrez Hall Harris Hartmann Hernandez Hill Hoffmann Hughes Jackson Jimenez Johnson Jones
    Kaiser Keller Khan Kim King Klein Koch Kowalski Lambert Lang Laurent Lee Lefebvre Leroy Lewis Lopez Martin Martinez Mayer Mendoza Mercier Meyer
    Miller Mitchell Moore Morales Moreau Morgan Morris Muller Murphy Navarro Nelson Neumann Nguyen Novak Ortiz Parker Patel Perez Peters Phillips
    Ramirez Ramos Richter Rivera Roberts Robinson Rodriguez Romero Rossi Rousseau Roux Ruiz Sanchez Schmidt Schneider Schulz Schwarz Scott
    Simon Singh Smith Stewart Suarez Taylor Thompson Torres Turner Vargas Vasquez Wagner Walker Wang Ward Weber White Williams
    Wilson Wolf Wood Wright Young Zimmermann
    """.split()
)

#: Capitalised words that stand in titles and places, not in names of people.
NOT_NAMES = frozenset(
    """
    Address Airport April August Avenue Award Bank Board Book Bridge Camp Castle Center Centre Chapter Church City Club College Committee
    Company Contact Council County Court Day December Department East Email Estate Fax February Figure Foundation Form Friday Game
    Garden Group Guide Hospital Hotel House Information Institute Island January July June Lake Law Letter Library March May
    Model Monday Mount Museum New North November October Office Order Park Part Phone Place Plan Point Policy Press Prize Product Project Report River
    Road Saturday School Section Series September Service South Square Station Street Sunday Support System Table Team Terms Test
    Theatre Thursday Tower Tuesday Union University Valley Version War Wednesday West
    """.split()
)

TITLES = frozenset("Mr Mrs Ms Miss Dr Prof Herr Frau Señor Señora Monsieur Madame Sr Sra Mme".split())

#: Registered lengths of account numbers by country.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22,
    "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22,
    "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30,
    "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31,
    "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24,
    "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}

#: How keys of well-known issuers begin.
KEY_HEADS = ("AKIA", "ASIA", "AIza", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "sk_live_", "sk_test_", "pk_live_", "rk_live_", "xoxb-", "xoxp-", "eyJ", "SG.", "npm_", "dop_v1_", "shpat_")


def area_code(digits: str) -> bool:
    """Whether ten digits have an area code and an exchange code that the North American plan assigns."""
    return all(x[0] in "23456789" and x[1:] != "11" for x in (digits[:3], digits[3:6])) and digits[1] != "9"
