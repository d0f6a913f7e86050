"""Official codes, vocabularies and weights that results must reproduce."""

# fixed values: official province codes, Panama 1-10
PA_PROVINCE_CODES = {
    "BOCAS DEL TORO": 1, "COCLE": 2, "COLON": 3, "CHIRIQUI": 4, "DARIEN": 5,
    "HERRERA": 6, "LOS SANTOS": 7, "PANAMA": 8, "PANAMA OESTE": 9, "VERAGUAS": 10,
}

# fixed values: official department codes, Colombia 11-43
CO_DEPARTMENT_CODES = {
    "ANTIOQUIA": 11, "AMAZONAS": 12, "ARAUCA": 13, "ATLANTICO": 14, "BOGOTA": 15,
    "BOGOTA D.C": 15, "BOGOTA DC": 15, "BOLIVAR": 16, "BOYACA": 17, "CALDAS": 18,
    "CAQUETA": 19, "CASANARE": 20, "CAUCA": 21, "CESAR": 22, "CHOCO": 23, "CORDOBA": 24,
    "CUNDINAMARCA": 25, "GUAINIA": 26, "GUAVIARE": 27, "HUILA": 28, "LA GUAJIRA": 29,
    "MAGDALENA": 30, "META": 31, "NARINO": 32, "NORTE DE SANTANDER": 33, "PUTUMAYO": 34,
    "QUINDIO": 35, "RISARALDA": 36, "SAN ANDRES Y PROVIDENCIA": 37, "SANTANDER": 38,
    "SUCRE": 39, "TOLIMA": 40, "VALLE DEL CAUCA": 41, "VAUPES": 42, "VICHADA": 43,
}

# fixed values: the five official categories
CATEGORY_CODES = {"CASA": 1, "APARTAMENTO": 2, "TERRENO": 3, "VEHICULO": 4, "MISCELANEO": 5}

# fixed values: fields that block publication when empty, and the secondary ones
FUNDAMENTAL_FIELDS = [
    "fecha", "hora", "proceso", "lugar", "categoria", "demandante", "demandado",
    "descripcion", "finca_matr", "provincia", "base", "fianza_porcentaje", "minimo_porcentaje",
]
SECONDARY_FIELDS = ["expediente", "lote_casa", "superficie", "plano"]

# fixed values: fields left out of the mean confidence / of the critical mean
DERIVED_FIELDS = ["codigo", "codigo_ubicacion", "codigo_prensa", "prevista"]
NON_CRITICAL_FIELDS = [
    "fianza_porcentaje", "minimo_porcentaje", "fianza", "minimo", "codigo", "codigo_ubicacion",
    "codigo_fuente", "plano", "superficie", "expediente",
]

# fixed values: legal percentages per country and their tolerance
LEGAL_DEPOSIT = {1: [10.0, 20.0, 25.0], 2: [40.0]}
LEGAL_MINIMUM = {1: [66.67, 50.0, 100.0], 2: [70.0, 50.0, 100.0]}
PERCENT_TOLERANCE = 1.0
CONFIDENCE_THRESHOLD = 0.70
REPUBLICATION_DAYS = 3

# fixed values: newspaper acronyms, month abbreviations and month names
NEWSPAPER_ACRONYMS = {"LA PRENSA": "LP", "METRO LIBRE": "ML", "LA ESTRELLA": "LE"}
MONTH_ABBR = ["ENE", "FEB", "MAR", "ABR", "MAY", "JUN", "JUL", "AGO", "SEP", "OCT", "NOV", "DIC"]
MONTHS = {
    "enero": "01", "febrero": "02", "marzo": "03", "abril": "04", "mayo": "05", "junio": "06",
    "julio": "07", "agosto": "08", "septiembre": "09", "setiembre": "09", "octubre": "10",
    "noviembre": "11", "diciembre": "12",
}

# fixed values: validator field classes
STRONG_FIELDS = ["expediente", "finca", "precio_base", "base", "finca_matr"]
MEDIUM_FIELDS = ["fecha_remate", "demandante", "demandado", "fecha"]
WEAK_FIELDS = ["lugar", "proceso", "hora", "provincia", "categoria", "fianza_porcentaje", "minimo_porcentaje"]

# fixed values: fields whose corrections may become suggestions
SUGGESTION_FIELDS = [
    "expediente", "lugar", "proceso", "demandante", "demandado", "categoria", "provincia",
    "finca_matr", "lote_casa", "plano", "superficie", "fecha", "hora", "codigo",
    "codigo_prensa", "pagina_prensa", "descripcion", "descripcion_completa", "prevista",
]
