"""Fixed values of the domain: they must be equal to the published rules for results to agree."""

# Bounding box of the country: lat_min, lat_max, lng_min, lng_max
BOUNDS = (14.5328, 32.7186, -118.5978, -86.7104)

FUELS = ["regular", "premium", "diesel"]
PRICE_MIN, PRICE_MAX = 5.0, 100.0

LEGAL_SUFFIXES = [
    r"S\.A\.P\.I\. DE C\.V\.",
    r"S\.A\.P\.I\. DE C\.V",
    r"S\.A\.P\.I\.",
    r"S\.A\. DE C\.V\. DE C\.V\.",
    r"S\.A\. DE C\.V\.",
    r"S\.A\. DE C\.V",
    r"S\. DE R\.L\. DE C\.V\.",
    r"S\. DE R\.L\. DE C\.V",
    r"S\. DE R\.L\.",
    r"S\.C\.S\.",
    r"S\.A\.",
    r"S\.C\.",
    r"A\.C\.",
    r"S\.P\.R\. DE R\.L\.",
    r"S\.P\.R\. DE R\.I\.",
    r"S\.P\.R\.",
    r"A\.P\.F\.",
    r"SOCIEDAD ANONIMA DE CAPITAL VARIABLE",
    r"SOCIEDAD ANONIMA",
    r"SOCIEDAD CIVIL",
    r"ASOCIACION CIVIL",
]

NAME_ABBREVIATIONS = {
    "GASO": "GASOLINERA",
    "GASLNA": "GASOLINERA",
    "GASNA": "GASOLINERA",
    "SERV": "SERVICIO",
    "SERVS": "SERVICIOS",
    "EXP": "EXPENDIO",
    "ESTAC": "ESTACION",
    "EST": "ESTACION",
    "DIST": "DISTRIBUIDORA",
    "COMB": "COMBUSTIBLE",
    "COMBS": "COMBUSTIBLES",
    "HIDROC": "HIDROCARBUROS",
    "PETROL": "PETROLEO",
    "CIA": "COMPANIA",
    "COMERC": "COMERCIAL",
    "INDUST": "INDUSTRIAL",
    "ADMON": "ADMINISTRACION",
    "GRAL": "GENERAL",
    "INTL": "INTERNACIONAL",
    "NAL": "NACIONAL",
    "MEXICAN": "MEXICANA",
}

STOP_WORDS = [
    "DE", "LA", "EL", "LOS", "LAS", "Y", "AND", "DEL",
    "EN", "A", "AL", "E", "O", "U",
    "TE", "SE", "SU", "MI", "TU",
    "CON", "POR", "SIN", "PARA", "DESDE",
]

STREET_ABBREVIATIONS = {
    "AV": "AVENIDA", "AVDA": "AVENIDA", "AVE": "AVENIDA",
    "BLVD": "BOULEVARD", "BULEVAR": "BOULEVARD", "BVAR": "BOULEVARD",
    "CALZ": "CALZADA", "CALL": "CALLE", "CARR": "CARRETERA", "CARRT": "CARRETERA",
    "CIRC": "CIRCUITO", "CDA": "CERRADA", "CERR": "CERRADA", "PRIV": "PRIVADA",
    "PROL": "PROLONGACION", "AND": "ANDADOR", "PERIF": "PERIFERICO", "PERI": "PERIFERICO",
    "RET": "RETORNO", "DIAG": "DIAGONAL", "C": "CALLE",
}

SETTLEMENT_ABBREVIATIONS = {
    "COL": "COLONIA", "FRACC": "FRACCIONAMIENTO", "FRAC": "FRACCIONAMIENTO",
    "URB": "URBANIZACION", "AMPL": "AMPLIACION", "BARR": "BARRIO", "POBL": "POBLADO",
    "RCH": "RANCHO", "EJ": "EJIDO", "RES": "RESIDENCIAL", "CD": "CIUDAD", "PTA": "PUNTA",
}

STATE_ALIASES = {
    "CDMX": "CIUDAD DE MEXICO", "D.F.": "CIUDAD DE MEXICO", "DF": "CIUDAD DE MEXICO",
    "DISTRITO FEDERAL": "CIUDAD DE MEXICO", "CIUDAD DE MEXICO": "CIUDAD DE MEXICO",
    "MEXICO D.F.": "CIUDAD DE MEXICO", "MEXICO DF": "CIUDAD DE MEXICO",
    "AGS": "AGUASCALIENTES", "AGUASCALIENTES": "AGUASCALIENTES",
    "BC": "BAJA CALIFORNIA", "BAJA CALIFORNIA": "BAJA CALIFORNIA",
    "BCS": "BAJA CALIFORNIA SUR", "BAJA CALIFORNIA SUR": "BAJA CALIFORNIA SUR",
    "CAMP": "CAMPECHE", "CAMPECHE": "CAMPECHE",
    "CHIS": "CHIAPAS", "CHIAPAS": "CHIAPAS",
    "CHIH": "CHIHUAHUA", "CHIHUAHUA": "CHIHUAHUA",
    "COAH": "COAHUILA", "COAHUILA": "COAHUILA", "COAHUILA DE ZARAGOZA": "COAHUILA",
    "COL": "COLIMA", "COLIMA": "COLIMA",
    "DGO": "DURANGO", "DURANGO": "DURANGO",
    "GTO": "GUANAJUATO", "GUANAJUATO": "GUANAJUATO",
    "GRO": "GUERRERO", "GUERRERO": "GUERRERO",
    "HGO": "HIDALGO", "HIDALGO": "HIDALGO",
    "JAL": "JALISCO", "JALISCO": "JALISCO",
    "MEX": "ESTADO DE MEXICO", "EDO MEX": "ESTADO DE MEXICO", "EDO. MEX.": "ESTADO DE MEXICO",
    "ESTADO DE MEXICO": "ESTADO DE MEXICO", "MEXICO": "ESTADO DE MEXICO",
    "MICH": "MICHOACAN", "MICHOACAN": "MICHOACAN", "MICHOACAN DE OCAMPO": "MICHOACAN",
    "MOR": "MORELOS", "MORELOS": "MORELOS",
    "NAY": "NAYARIT", "NAYARIT": "NAYARIT",
    "NL": "NUEVO LEON", "NUEVO LEON": "NUEVO LEON",
    "OAX": "OAXACA", "OAXACA": "OAXACA",
    "PUE": "PUEBLA", "PUEBLA": "PUEBLA",
    "QRO": "QUERETARO", "QUERETARO": "QUERETARO", "QUERETARO DE ARTEAGA": "QUERETARO",
    "QROO": "QUINTANA ROO", "Q ROO": "QUINTANA ROO", "QUINTANA ROO": "QUINTANA ROO",
    "SLP": "SAN LUIS POTOSI", "SAN LUIS POTOSI": "SAN LUIS POTOSI",
    "SIN": "SINALOA", "SINALOA": "SINALOA",
    "SON": "SONORA", "SONORA": "SONORA",
    "TAB": "TABASCO", "TABASCO": "TABASCO",
    "TAMPS": "TAMAULIPAS", "TAMAULIPAS": "TAMAULIPAS",
    "TLAX": "TLAXCALA", "TLAXCALA": "TLAXCALA",
    "VER": "VERACRUZ", "VERACRUZ": "VERACRUZ", "VERACRUZ DE IGNACIO DE LA LLAVE": "VERACRUZ",
    "YUC": "YUCATAN", "YUCATAN": "YUCATAN",
    "ZAC": "ZACATECAS", "ZACATECAS": "ZACATECAS",
}

# Brand aliases in table order: the first one that contains, or is contained, wins.
BRAND_ALIASES = {
    "PEMEX": "PEMEX", "PETRO7": "PEMEX", "PETRO 7": "PEMEX", "GASOLINERA PEMEX": "PEMEX",
    "ESTACION PEMEX": "PEMEX", "SERVICIO PEMEX": "PEMEX", "PETROLEOS MEXICANOS": "PEMEX",
    "PETROLEOS MEX": "PEMEX",
    "OXXO GAS": "OXXO GAS", "OXXOGAS": "OXXO GAS", "OXXO": "OXXO GAS", "CIRCLE K": "OXXO GAS",
    "CIRCLEK": "OXXO GAS", "CIRCLE-K": "OXXO GAS",
    "SHELL": "SHELL", "SHELL MEXICO": "SHELL", "SHELL MEX": "SHELL", "SHELLMEX": "SHELL",
    "BP": "BP", "AMPM": "BP", "AM PM": "BP", "BRITISH PETROLEUM": "BP", "BP MEXICO": "BP",
    "TOTAL": "TOTALENERGIES", "TOTALENERGIES": "TOTALENERGIES", "TOTAL ENERGIES": "TOTALENERGIES",
    "TOTAL ENERGY": "TOTALENERGIES", "TOTALENERGIE": "TOTALENERGIES",
    "HIDROSINA": "HIDROSINA", "HIDROSINAGAS": "HIDROSINA",
    "G500": "G500", "GREENGAS": "G500", "GREEN GAS": "G500", "GAS 500": "G500", "G 500": "G500",
    "REPSOL": "REPSOL", "REPSOL MEXICO": "REPSOL",
    "MOBIL": "MOBIL", "EXXONMOBIL": "MOBIL", "EXXON MOBIL": "MOBIL", "EXXON": "MOBIL",
    "CHEVRON": "CHEVRON", "CHEVRON MEXICO": "CHEVRON", "TEXACO": "CHEVRON",
    "REDCO": "REDCO", "REDCO GAS": "REDCO",
    "ACCEL": "ACCEL", "ACCEL GAS": "ACCEL",
    "BAJA GAS": "BAJA GAS", "BAJAGAS": "BAJA GAS",
    "PETRO GLOBAL": "PETRO GLOBAL", "PETROGLOBAL": "PETRO GLOBAL",
    "ORSAN": "ORSAN", "ORSAN GAS": "ORSAN",
    "ZETA GAS": "ZETA GAS", "ZETAGA": "ZETA GAS",
    "ONEXPO": "ONEXPO",
    "FUELGAS": "FUELGAS", "FUEL GAS": "FUELGAS",
    "COMBUSTIBLES DEL NORTE": "COMBUSTIBLES DEL NORTE", "COMB DEL NORTE": "COMBUSTIBLES DEL NORTE",
    "GASOLINA EXPRESS": "GASOLINA EXPRESS", "GAS EXPRESS": "GASOLINA EXPRESS",
    "INDEPENDIENTE": None, "INDEPENDENT": None, "SIN MARCA": None, "SIN FRANQUICIA": None,
}
BRANDS = sorted({b for b in BRAND_ALIASES.values() if b})

SOURCE_RELIABILITY = {"cre": 1.00, "denue": 0.90, "brand": 0.85, "osm": 0.75, "google": 0.70}
SOURCE_RANK = {"cre": 1, "denue": 2, "brand": 3, "osm": 4, "google": 5}
WEIGHTS = {"name": 0.25, "geo": 0.35, "brand": 0.20, "address": 0.15, "source": 0.05}
AUTO_MATCH, REVIEW_MIN = 0.85, 0.65
NEUTRAL = 0.3

# Latitude ranges used by the state consistency rule
STATE_LATITUDES = {
    "CIUDAD DE MEXICO": (19.05, 19.60),
    "JALISCO": (18.92, 22.75),
    "NUEVO LEON": (23.17, 27.79),
    "BAJA CALIFORNIA": (28.00, 32.72),
    "CHIAPAS": (14.53, 17.80),
    "YUCATAN": (19.50, 21.70),
    "SONORA": (26.00, 32.00),
}

STATE_REGIONS = {
    "Baja California": "Noroeste", "Baja California Sur": "Noroeste", "Sonora": "Noroeste",
    "Sinaloa": "Noroeste", "Chihuahua": "Norte", "Coahuila": "Norte", "Durango": "Norte",
    "Zacatecas": "Norte", "Nuevo León": "Noreste", "Tamaulipas": "Noreste",
    "San Luis Potosí": "Centro-Norte", "Aguascalientes": "Centro-Norte",
    "Jalisco": "Centro-Occidente", "Colima": "Centro-Occidente", "Nayarit": "Centro-Occidente",
    "Michoacán": "Centro-Occidente", "Guanajuato": "Centro", "Querétaro": "Centro",
    "Hidalgo": "Centro", "Ciudad de México": "Centro", "Estado de México": "Centro",
    "Morelos": "Centro", "Tlaxcala": "Centro", "Puebla": "Centro-Sur", "Guerrero": "Centro-Sur",
    "Oaxaca": "Sur-Sureste", "Chiapas": "Sur-Sureste", "Veracruz": "Sur-Sureste",
    "Tabasco": "Sur-Sureste", "Campeche": "Sur-Sureste", "Yucatán": "Sur-Sureste",
    "Quintana Roo": "Sur-Sureste",
}

# Month-day and name of the days that put pressure on prices, in checking order
HOLIDAYS = [
    ("01-01", "Año Nuevo"),
    ("02-03", "Día de la Constitución"),
    ("03-17", "Natalicio de Benito Juárez"),
    ("04-02", "Semana Santa"),
    ("04-03", "Semana Santa"),
    ("05-01", "Día del Trabajo"),
    ("09-16", "Día de la Independencia"),
    ("11-02", "Día de los Muertos"),
    ("11-17", "Revolución Mexicana"),
    ("12-12", "Día de la Virgen"),
    ("12-24", "Nochebuena"),
    ("12-25", "Navidad"),
    ("12-31", "Nochevieja"),
]
