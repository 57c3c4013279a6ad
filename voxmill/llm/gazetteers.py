"""Small public gazetteers for personal data; callers may pass larger ones of their own."""

from __future__ import annotations

from typing import NamedTuple

# Common given names in English, German, French and Spanish.
GIVEN_NAMES = frozenset(
    "Adam Alan Albert Alejandro Alexander Alexandre Alice Amanda Amy Ana Andrea Andreas Andrew Angela Anna Anne Antoine "
    "Antonio Arthur Barbara Beatriz Benjamin Bernd Bernard Brian Camille Carla Carlos Carmen Caroline Catherine Charles "
    "Charlotte Chloe Christian Christine Christopher Claire Claudia Cristina Daniel David Deborah Dennis Diego Dieter "
    "Donald Edward Elena Elizabeth Emily Emma Eric Eva Felix Fernando Florian Francisco Frank Gabriel George Gerard "
    "Gerhard Hannah Hans Harold Heinz Helen Helga Henri Henry Ines Isabel Isabelle Jack Jacques James Jan Jane Janet "
    "Javier Jean Jeffrey Jennifer Jessica Joan John Jonas Jorge Jose Joseph Joshua Juan Julia Julie Julien Karen Karl "
    "Katharina Kevin Klaus Laura Lars Lena Linda Lisa Louis Louise Lucas Lucia Luis Lukas Manuel Marc Marco Margaret "
    "Maria Marie Marion Mark Markus Marta Martin Mary Matthew Max Melissa Michael Michel Michelle Miguel Monika Nancy "
    "Nathan Nicolas Nicole Olivia Olivier Oscar Pablo Patricia Patrick Paul Pedro Peter Petra Philippe Pierre Rachel "
    "Ralf Ramon Raul Rebecca Richard Robert Rosa Ruth Ryan Sabine Samuel Sandra Sara Sarah Sebastian Sergio Simon Sofia "
    "Sophie Stefan Stephanie Stephen Steven Susan Susanne Sylvie Teresa Theo Thomas Timothy Tobias Ursula Victor".split()
)
# Common family names in the same languages.
FAMILY_NAMES = frozenset(
    "Adams Alonso Alvarez Anderson Bailey Baker Bauer Becker Bernard Bertrand Blanc Bonnet Braun Brown Campbell Carter "
    "Castro Clark Collins Cook Cooper Cruz Davis Diaz Dubois Dupont Durand Edwards Evans Fernandez Fischer Flores Fournier "
    "Garcia Garnier Girard Gomez Gonzalez Green Gutierrez Hall Harris Hartmann Hernandez Hill Hoffmann Hughes Jackson "
    "Jimenez Johnson Jones Keller King Klein Koch Krause Krueger Lambert Laurent Lee Lefebvre Lehmann Leroy Lewis Lopez "
    "Maier Marquez Martin Martinez Mayer Meyer Miller Mitchell Moore Morales Moreau Moreno Morgan Morris Mueller Murphy "
    "Murray Nelson Neumann Ortiz Parker Perez Peterson Petit Phillips Ramirez Ramos Richard Richter Rivera Roberts "
    "Robinson Rodriguez Rogers Romero Rossi Roux Ruiz Russell Sanchez Schmidt Schmitt Schneider Schroeder Schulz Schwarz "
    "Scott Simon Smith Stewart Taylor Thomas Thompson Torres Turner Vasquez Vincent Wagner Walker Walter Ward Watson "
    "Weber Werner White Williams Wilson Wolf Wood Wright Young Zimmermann Müller Schröder Krüger García López González "
    "Martínez Sánchez Pérez Fernández Gómez Díaz Jiménez Muñoz Núñez Lefèvre".split()
)
# Generic and country top-level domains in wide use.
TOP_LEVEL_DOMAINS = frozenset(
    "com org net edu gov mil int info biz name io ai app dev co me tv eu de fr es uk us ca au at be br ch cl cn cz dk fi gr "
    "hu ie il in it jp kr lu mx nl no nz pe pl pt ro ru se sg sk tr ua za".split()
)
# Lengths of international bank account numbers by country.
ACCOUNT_LENGTHS = dict(
    AT=20, BE=16, BG=22, CH=21, CY=28, CZ=24, DE=22, DK=18, EE=20, ES=24, FI=18, FR=27, GB=22, GR=27, HR=21, HU=28, IE=22,
    IS=26, IT=27, LI=21, LT=20, LU=20, LV=21, MC=27, MT=31, NL=18, NO=15, PL=28, PT=25, RO=24, SE=24, SI=19, SK=24,
)
# Calling codes of countries.
CALLING_CODES = frozenset(
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 "
    "91 92 93 94 95 98 212 213 216 218 234 254 351 352 353 354 355 356 357 358 359 370 371 372 380 381 385 386 420 421 423 "
    "852 886 961 962 965 966 971 972 974".split()
)
# Words that end or begin the name of a street.
STREET_WORDS = frozenset(
    "street st avenue ave road rd lane ln drive dr court ct boulevard blvd square straße strasse str weg platz allee rue "
    "chemin place calle avenida plaza paseo".split()
)


class Gazetteers(NamedTuple):
    given: frozenset[str] = GIVEN_NAMES
    family: frozenset[str] = FAMILY_NAMES
    domains: frozenset[str] = TOP_LEVEL_DOMAINS
    accounts: dict[str, int] = ACCOUNT_LENGTHS
    calling: frozenset[str] = CALLING_CODES
    streets: frozenset[str] = STREET_WORDS


def issuer_known(digits: str) -> bool:
    """If a card number starts and is as long as those of the large issuers."""
    n, two, four = len(digits), int(digits[:2]), int(digits[:4])
    return (
        (digits[0] == "4" and n in (16, 19))
        or (n == 16 and (51 <= two <= 55 or 2221 <= four <= 2720 or two in (35, 65) or four == 6011))
        or (n == 15 and two in (34, 37))
        or (n == 14 and two in (30, 36, 38, 39))
    )


def public_address(parts: list[int]) -> bool:
    """If an IPv4 address is one that a person's machine could have on the open network."""
    a, b = parts[:2]
    local = a in (0, 10, 127) or a >= 224 or (a == 172 and 16 <= b <= 31) or (a, b) in ((192, 168), (169, 254))
    return not local
