"""Taxonomies and constants of the reporting model.

Lookups are tiny literal maps (a few dozen entries fixed in code), applied as JVM-side
``map`` expressions: no join, no shuffle, and their size cannot grow with the data.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------------------------
# Fixed values. They must equal the values of the analysed result workflow for the marts to
# be right; they are stated here as plain text, in their original order.
# ---------------------------------------------------------------------------------------------

# Prefix of a generator/storage class code (text before the first "-") -> technology.
TECH_SET = {
    'wind': 'Wind',
    'clcl': 'Coal',
    'cbcf': 'Bio',
    'cgcf': 'Gas-CC',
    'clng': 'Gas-CT',
    'ngcc': 'Gas-CC',
    'ngst': 'Gas-CT',
    'nggt': 'Gas-CT',
    'dfcc': 'Gas-CC',
    'dfgt': 'Hydrogen',
    'ptsg': 'Gas-CT',
    'ngcr': 'Gas CCS',
    'g2hc': 'Hydrogen',
    'g2ht': 'Hydrogen',
    'h2cc': 'Hydrogen',
    'h2gt': 'Hydrogen',
    'othc': 'Bio',
    'bioe': 'Bio',
    'bioc': 'Bio',
    'becs': 'Bio CCS',
    'ccs9': 'Coal CCS',
    'clch': 'Coal CCS',
    'ncch': 'Gas CCS',
    'nucl': 'Nuclear',
    'nuca': 'Nuclear',
    'hydr': 'Hydro',
    'geot': 'Geothermal',
    'wnos': 'Offshore Wind',
    'wnosd': 'Offshore Wind',
    'pvft': 'Solar',
    'pvsx': 'Solar',
    'pvdx': 'Solar',
    'pvftm': 'Solar',
    'pvrf': 'Solar',
    'cspr': 'Solar',
    'enee': 'Energy Efficiency',
}

# October-2010 dollars -> April-2024 dollars (GDP deflator ratio).
DEFLATOR_2010_TO_2024 = 1.396161885

# Raw domain names of the model's symbols -> canonical column names.
COLUMN_NAMES = {"i": "tech_class",
                "j": "tech_class",
                "v": "vintage",
                "t": "year",
                "r": "region",
                "s": "segment",
                "h": "hour",
                "f": "fuel"}

# Technologies kept in the hourly availability marts.
RE_TECH = ['Solar', "Wind", "Offshore Wind"]

# Model years.
YEAR_LIST = [2020, 2025, 2030, 2035, 2040, 2045, 2050]

# Report generator class with its digits removed -> technology.
TYPE_TO_TECH = {"xnuc": "Nuclear", "nnuc": "Nuclear", "nuca": "Nuclear",
                "geot": "Geothermal", "hydr": "Hydro", "bioe": "Bio", "othc": "Bio", "h2": "Hydrogen",
                "becs": "Bio CCS", "xcol": "Coal", "ncol": "Coal", "clcs": "Coal CCS",
                "xngc": "Gas-CC", "nngc": "Gas-CC", "ngcs": "Gas CCS", "xngp": "Gas-CT", "nngp": "Gas-CT", "dfcap": "Gas-CT",
                "ptpk": "Gas-CT", "h2cc": "Hydrogen", "xwnd": "Wind", "nwnd": "Wind",
                "wnos": "Wind", "xspv": "Solar", "nspv": "Solar", "xcsp": "Solar",
                "ncsp": "Solar", "stor": "Storage", "rfpv": "Solar", "peakload": "Peak Load"}

# Model region -> reporting area.
STATE_MAPPING = {'BANC_TID': "ca", 'IID': "ca", 'LDWP': "ca", 'Other': "ca", 'PGE': "ca", 'SCE': "ca", 'SDGE': "ca",
                 'Oregon': "rest_of_wecc", 'Washington': "rest_of_wecc", 'Nevada': "rest_of_wecc", 'Arizona': "rest_of_wecc",
                 'New_Mexico': "rest_of_wecc", 'Utah': "rest_of_wecc", 'Colorado': "rest_of_wecc", 'Idaho': "rest_of_wecc",
                 'Montana': "rest_of_wecc", 'Wyoming': "rest_of_wecc"}

# Display order of technologies in figure tables, first to last (the colour list reversed).
TECH_ORDER = ["Storage", "Solar", "Wind", "Hydrogen", "Gas CCS", "Gas-CT", "Gas-CC",
              "Coal CCS", "Coal", "Bio CCS", "Bio", "Hydro", "Geothermal", "Nuclear"]

# Long technology label -> technology; "DROP" marks labels to remove.
TECH_SUB = {"100% Hydrogen combined cycle": "Hydrogen", "100% Hydrogen gas turbine": "Hydrogen",
            "Biomass cofire": "Bio", "Biomass with 90% capture": "Bio CCS",
            "Coal": "Coal", "Coal converted to biomass": "Bio", "Coal retrofit with 95% capture": "Coal CCS",
            "Community Solar": "Solar", "Concentrated Solar Power (thermal)": "Solar", "Conventional hydro": "Hydro",
            "Converted NG steam": "Gas-CT", "Dedicated biomass generation": "Bio", "Dual Fuel combined cycle (NG Diesel or H2)": "Gas-CC",
            "Dual Fuel gas turbine (NG Diesel or H2)": "Gas-CT", "Existing biomass and other": "Bio",
            "Gas cofire": "Gas-CC", "Geothermal": "Geothermal", "Lithium_Ion-capacity": "Storage", "Energy Efficiency": "DROP",
            "Lithium_Ion-energy": "DROP", "NG combined cycle": "Gas-CC", "NG gas turbine": "Gas-CT", "NG steam": "Gas-CT",
            "NGCC CCS retrofit (95% capture)": "Gas CCS", "NGCC converted to be H2": "Hydrogen", "NGGT converted to be H2": "Hydrogen",
            "New Coal with CCS (99% capture)": "Coal CCS", "New NGCC with CCS (97% capture)": "Gas CCS",
            "Nuclear Advanced": "Nuclear", "Nuclear Gen III": "Nuclear", "Petroleum steam gas turbine or IC": "Gas-CT",
            "Pumped_Hydro-capacity": "DROP", "Pumped_Hydro-energy": "DROP", "Rooftop Solar PV": "Solar",
            "Utility Double Axis PV": "Solar", "Utility Fixed Tilt PV": "Solar", "Utility Single Axis PV": "Solar",
            "Wind": "Wind"}

# Demand-report line items that make up hydrogen load, and their report group.
HYDROGEN_GROUP = "demand"
HYDROGEN_TYPES = ["h2prod_ht", "h2prod_ne", "h2prod_pa", "h2stortrn"]

# Dispatch technologies left out of the dispatch figure tables.
DISPATCH_EXCLUDED = ["Coal", "Coal CCS", "Gas CCS", "Energy Efficiency"]

# Peak-hour ranking depth, outlier load floor, cumulative-investment cutoff, comparison years.
TOP_K_HOURS = 25
LOAD_FLOOR = 5
CUMULATIVE_CUTOFF = 2040
COMPARISON_YEARS = [2030, 2040, 2050]

# Calendar used to turn hour-of-year into timestamps (the model year starts on the same weekday).
CALENDAR_START = "2026-01-01 00:00:00"
HOURS_PER_YEAR = 8760

# ---------------------------------------------------------------------------------------------


def storage_label(kind: str) -> str:
    """Technology labels of aggregated storage rows."""
    return {"capacity": "Storage-capacity", "energy": "Storage-energy",
            "charge": "Storage-charge", "discharge": "Storage-discharge"}[kind]
