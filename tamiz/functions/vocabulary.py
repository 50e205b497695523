"""Word lists, tables, patterns and labels that results depend on, in their natural order."""

ACCENTED = "áàäâéèëêíìïîóòöôúùüûñç"
PLAIN = "aaaaeeeeiiiioooouuuunc"

# Company names: legal forms and generic first words that say nothing of the company.
LEGAL_FORMS = r"\b(s\s?a\s?c|sac|s\s?a\s?a|saa|s\s?a|sa|s\s?r\s?l|srl|e\s?i\s?r\s?l|eirl|ltda|inc|corp|peru|del peru|s de rl|company|cia|compania)\b"
GENERIC_NAMES = r"\b(corporacion|inversiones|distribuidora|comercial|industrias|empresa)\b"
LOCATION_FILLERS = r"\b(peru|lima metropolitana|provincia de|distrito de|region)\b"

# Relative dates.
TODAY = ("hoy", "today", "recien", "ahora", "minuto", "minute", "hora", "hour")
YESTERDAY = ("ayer", "yesterday")
UNIT_DAYS = ((("dia", "day"), 1), (("semana", "week"), 7), (("mes", "month"), 30), (("ano", "year"), 365))

# Locations.
DEPARTMENTS = (
    "amazonas", "ancash", "apurimac", "arequipa", "ayacucho", "cajamarca", "callao", "cusco", "huancavelica", "huanuco", "ica", "junin", "la libertad",
    "lambayeque", "lima", "loreto", "madre de dios", "moquegua", "pasco", "piura", "puno", "san martin", "tacna", "tumbes", "ucayali",
)
LIMA_PROVINCES = (
    "barranca", "cajatambo", "canta", "canete", "huaral", "huarochiri", "huaura", "oyon", "yauyos", "san vicente de canete", "huacho", "chancay", "supe",
    "paramonga", "matucana", "imperial", "mala", "chilca", "asia", "san bartolome", "santa eulalia", "pativilca",
)
LOCATION_NOISE = ("peru", "provincia de", "province", "region", "departamento de", "y alrededores", "and surrounding area", "metropolitan area", "area metropolitana")
CALLAO_DISTRICTS = ("bellavista", "la perla", "la punta", "ventanilla", "mi peru", "carmen de la legua")
DISTRICTS = {
    "ancon": (-11.7731, -77.1761), "ate vitarte": (-12.0253, -76.9205), "ate": (-12.0253, -76.9205), "barranco": (-12.1481, -77.0211), "brena": (-12.0601, -77.0449),
    "carabayllo": (-11.8504, -77.0315), "chaclacayo": (-11.9723, -76.7686), "chorrillos": (-12.1923, -77.0219), "cieneguilla": (-12.0911, -76.7699), "comas": (-11.9332, -77.0448),
    "el agustino": (-12.0487, -76.9996), "independencia": (-11.9922, -77.0504), "jesus maria": (-12.0781, -77.0464), "la molina": (-12.0838, -76.9248), "la victoria": (-12.0651, -77.0305),
    "lince": (-12.0845, -77.0334), "los olivos": (-11.9644, -77.0706), "lurigancho chosica": (-11.9392, -76.7028), "chosica": (-11.9392, -76.7028), "lurin": (-12.2741, -76.8715),
    "magdalena del mar": (-12.0923, -77.0733), "magdalena": (-12.0923, -77.0733), "miraflores": (-12.1214, -77.0259), "pachacamac": (-12.1293, -76.8587), "pucusana": (-12.4831, -76.7971),
    "pueblo libre": (-12.0747, -77.0601), "puente piedra": (-11.8661, -77.0768), "punta hermosa": (-12.3361, -76.8252), "punta negra": (-12.3654, -76.7963), "rimac": (-12.0203, -77.0354),
    "san bartolo": (-12.3921, -76.7818), "san borja": (-12.1064, -76.9989), "san isidro": (-12.1166, -77.0513), "san juan de lurigancho": (-12.0163, -76.9854), "sjl": (-12.0163, -76.9854),
    "san juan de miraflores": (-12.1555, -76.9678), "sjm": (-12.1555, -76.9678), "san luis": (-12.0754, -76.9959), "san martin de porres": (-11.9961, -77.0713), "smp": (-11.9961, -77.0713),
    "san miguel": (-12.0786, -77.0952), "santa anita": (-12.0441, -76.9686), "santa maria del mar": (-12.4111, -76.7761), "santa rosa": (-11.8081, -77.1654), "santiago de surco": (-12.1444, -77.0051),
    "surco": (-12.1444, -77.0051), "surquillo": (-12.1141, -77.0205), "villa el salvador": (-12.2111, -76.9361), "ves": (-12.2111, -76.9361), "villa maria del triunfo": (-12.1581, -76.9275),
    "vmt": (-12.1581, -76.9275), "cercado de lima": (-12.0463, -77.0427), "lima": (-12.0463, -77.0427), "callao": (-12.0630, -77.1469), "bellavista": (-12.0625, -77.1291),
    "carmen de la legua": (-12.0427, -77.0984), "la perla": (-12.0671, -77.1118), "la punta": (-12.0706, -77.1601), "ventanilla": (-11.8654, -77.1251), "mi peru": (-11.8541, -77.1154),
}

# Titles.
TRAINEE_TITLE = r"\b(pract[a-z]*|practicante|practica|practicas|trainee|pasante|intern|preprofesional|pre profesional|pre-profesional)\b"
SENIORITY = (
    ("Dirección", (r"\bdirector", r"\bdirectora\b", "gerente general", r"\bceo\b", r"\bcfo\b", r"\bcoo\b", r"\bcto\b", "country manager", "vicepresidente")),
    ("Gerencia", (r"\bgerente\b", r"\bgerencia\b", "head of", r"\bmanager\b")),
    ("Jefatura", (r"\bjefe\b", r"\bjefa\b", r"\bjefatura\b", "sub gerente", "subgerente")),
    ("Supervisión", (r"\bsupervisor", r"\bcoordinador", r"\blider\b", r"\bleader\b", r"\bencargad[oa]\b", "responsable de")),
    ("Senior", (r"(?<!semi )\bsenior\b", r"\bsr\.", r"\bsr\b", r"\bespecialista\b", r"\bexperto\b")),
    ("Semi Senior", (r"semi\s*senior", r"\bssr\b", r"\banalista\b")),
    ("Junior", (r"\bjunior\b", r"\bjr\.", r"\bjr\b", r"\btrainee\b", r"\bauxiliar\b", r"\basistente\b", r"\baprendiz\b")),
    ("Practicante", (r"\bpracticante\b", "practicas pre", "practicas profesionales", r"\bpasante\b", r"\binternship\b", r"\bintern\b")),
)
NO_SENIORITY = "Operativo / Sin especificar"
SENIOR_LEVELS = ("Dirección", "Gerencia", "Jefatura", "Supervisión", "Senior")

# Career gate, on normalised text.
CAREER = (
    r"(?:ingen[a-z]{0,6}\s+(?:de\s+)?industrial|ing[.,]?\s*industrial|ing[.,]?\s*ind\b|industrial\s+engineer(?:ing)?"
    r"|(?:ingen[a-z]{0,6}|bachiller|egresad[oa]|titulad[oa]|estudiante|licenciad[oa]|carrera|carreras)[^.;\n]{0,40}\bindustrial\b)"
)
NOT_CAREER = r"(?:sector|rubro|ambito|parque|zona|planta|seguridad|higiene|corporacion|grupo|industria)\s+(?:\w+\s+){0,2}industrial"
CAREER_NAMED = r"\b(ingenieria|ing[.,]|bachiller|egresado|estudiante)\s+industrial\b"
MAX_DAYS, MAX_MONTHS, DETAIL_FROM_CHARS = 30, 24, 400

# Salary.
SALARY_WORDS = ("sueldo", "salario", "remuneracion", "subvencion", "basico", "haber", "ingreso mensual", "renta mensual", "pago mensual", "banda salarial", "rango salarial", "planilla de", "honorarios", "retribucion")
AMOUNT = r"(\d{1,3}(?:[.,]\d{3})+(?:[.,]\d{2})?|\d{3,6}(?:[.,]\d{2})?)"
SOLES = r"(?i)(?:s/\.?|soles|pen)\s*[:.]?\s*" + AMOUNT
DOLLARS = r"(?i)(?:us\$|usd|\$)\s*[:.]?\s*" + AMOUNT
SOLES_RANGE, DOLLARS_RANGE = (500.0, 60000.0), (400.0, 20000.0)

# Ordered groups of words: the first group that a text contains gives the label.
EDUCATION = (
    ("Postgrado", ("maestria", "mba", "doctorado", "postgrado", "posgrado")),
    ("Titulado/Colegiado", ("colegiado", "titulado", "habilitado", "licenciado en")),
    ("Bachiller", ("bachiller",)),
    ("Universitario / Egresado", ("universitari", "egresado", "carrera profesional")),
    ("Técnico", ("tecnico", "instituto", "senati", "tecsup", "cibertec")),
    ("Secundaria", ("secundaria completa", "quinto de secundaria")),
)
NO_EDUCATION = "No especificado"
ENGLISH = (
    ("Avanzado", ("ingles avanzado", "ingles fluido", "advanced english", "bilingue")),
    ("Intermedio", ("ingles intermedio", "ingles b1", "ingles b2")),
    ("Básico", ("ingles basico", "ingles a1", "ingles a2")),
)
ENGLISH_NAMED, ENGLISH_WORD = "Mencionado sin nivel", r"\bingles\b"
BENEFITS = (
    ("Planilla", ("planilla", "beneficios de ley")),
    ("EPS / Seguro", ("eps", "seguro medico", "seguro de salud")),
    ("Bonos / Comisiones", ("bono", "comision", "incentivo")),
    ("Capacitaciones", ("capacitacion", "linea de carrera", "convenio educativo")),
    ("Alimentación", ("alimentacion", "almuerzo", "vale de alimento", "comedor")),
    ("Movilidad", ("movilidad", "transporte cubierto", "bus de personal")),
)
RELATED_CAREERS = r"(?i)\b(y/?o\s*afines|carreras\s+afines|o\s+afines|y\s+afines)\b"
OTHER_CAREERS = ("administracion", "economia", "contabilidad", "ing sistemas", "ingenieria de sistemas", "ingenieria mecanica", "ingenieria electrica", "ingenieria civil", "ingenieria quimica", "marketing", "psicologia", "derecho")
SHIFT = r"(?<![\d,.])(\d{1,2})\s*[x×]\s*(\d{1,2})(?![\d])"
CAMP_WORDS = ("campamento", "unidad minera", "alojamiento cubierto", "hospedaje cubierto", "msnm", "internado", "alimentacion y alojamiento", "proyecto minero", "tajo abierto")
SHIFT_NOISE = ("camioneta", "4x4", "pickup", "metos", "tamano", "24x7")
ON_SITE = ("100% presencial", "de manera presencial", "trabajo presencial", "modalidad presencial")
REMOTE = ("remoto", "teletrabajo", "home office")
HYBRID = ("hibrido", "hybrid", "semi presencial", "semipresencial")
AREAS_BY_PORTAL = (
    ("Logística / Cadena de Suministro", ("logistica", "almacen", "compras", "distribucion", "expedicion", "supply", "inventario")),
    ("Operaciones y Producción", ("operacion", "produccion", "planta", "mantenimiento", "manufactura")),
    ("Calidad y Procesos", ("calidad", "sig", "ssoma", "procesos")),
    ("Tecnología / TI", ("sistemas", "tecnologia", "software", "ti", "data")),
    ("Comercial / Ventas", ("comercial", "ventas", "marketing")),
    ("Administración y Finanzas", ("administra", "finanza", "contabi")),
    ("Recursos Humanos", ("recursos humanos", "rrhh", "gestion humana")),
)
AREAS_BY_TEXT = (
    ("Logística / Cadena de Suministro", ("logistica", "logistico", "almacen", "almacenes", "inventario", "inventarios", "compras", "despacho", "distribucion", "embarque", "flotas", "transporte", "cadena de suministro", "supply chain", "kardex", "picking", "packing")),
    ("Operaciones y Producción", ("operaciones", "operacion", "produccion", "planta", "mantenimiento", "manufactura", "procesos", "mejora continua", "planeamiento de la produccion", "pcp")),
    ("Calidad y Procesos", ("calidad", "aseguramiento", "sig", "ssoma", "seguridad industrial", "control de calidad", "auditoria de procesos")),
    ("Tecnología / TI", ("sistemas", "software", "desarrollador", "programador", "tecnologia", "it", "ti", "devops", "data", "analitica", "bi", "backend", "frontend", "fullstack")),
    ("Comercial / Ventas", ("ventas", "comercial", "ejecutivo de ventas", "kam", "key account", "marketing", "telemarketing")),
    ("Administración y Finanzas", ("administra", "administracion", "finanzas", "contabilidad", "tesoreria", "facturacion", "cobranzas")),
    ("Recursos Humanos", ("recursos humanos", "rrhh", "gestion humana", "talento humano", "seleccion", "reclutamiento")),
)
DEFAULT_AREA = "Ingeniería / Operaciones"

# Profile rules: points, label, words.
TOOLS = (
    (10, "Power BI", ("power bi", "powerbi", " dax", "power query", "tablero de control", "dashboard")),
    (7, "SQL", ("sql", "consultas", "base de datos")),
    (6, "SAP", ("sap", "erp")),
    (5, "Python", ("python", "automatizacion de reportes")),
    (5, "Excel avanzado", ("excel avanzado", "tablas dinamicas", "macros", "vba", "buscarv")),
    (4, "MS Project", ("ms project", "msproject", "microsoft project", "cronograma")),
    (3, "Power Platform", ("power apps", "power automate")),
)
LANES = (
    ("Control de proyectos", 34, (
        (12, "Presupuestos CAPEX/OPEX", ("presupuesto", "capex", "opex", "presupuestal")),
        (8, "Forecast y desviaciones", ("forecast", "desviacion", "proyeccion financiera")),
        (8, "Control de gestión", ("control de gestion", "controller", "control interno", "planeamiento financiero")),
        (6, "Valor ganado / EVM", ("valor ganado", "evm", "curva s", "avance de obra", "pmbook", "pmbok", "pmo")),
        (5, "Contratos y valorizaciones", ("valorizacion", "contrato", "licitacion")),
        (5, "Costos y márgenes", ("costos", "margen", "rentabilidad", "centro de costo")),
    )),
    ("Supply chain", 34, (
        (10, "Inventarios", ("inventario", "stock", "conteo ciclico", "exactitud de registro", "eri", "abc")),
        (8, "Almacén", ("almacen", "warehouse", "eru", "ubicaciones", "rotacion")),
        (8, "Planeamiento de demanda", ("pcp", "demanda", "planeamiento de la produccion", "s&op", "sop")),
        (8, "Supply chain", ("supply chain", "cadena de suministro", "logistica")),
        (6, "Despacho y transporte", ("despacho", "distribucion", "transporte", "trazabilidad")),
        (5, "Compras", ("compras", "abastecimiento", "procura", "proveedores")),
    )),
    ("Mejora de procesos", 22, (
        (8, "Mejora continua", ("mejora continua", "lean", "kaizen", "six sigma", "vsm")),
        (6, "Mapeo de procesos", ("mapeo de procesos", "levantamiento de procesos", "flujograma", "estandarizacion")),
        (5, "KPIs", ("kpi", "indicadores", "tablero")),
        (5, "Automatización", ("automatizacion", "digitalizacion", "rpa")),
    )),
)
TOOLS_CAP, DOMAIN_CAP, FIT_CAP = 28, 34, 22
HIGH_ENGLISH = r"ingles\s+(?:avanzado|fluido|c1|c2|bilingue)|nivel\s+avanzado\s+de\s+ingles|fluent english|advanced english"
LICENSED = r"colegiatura|colegiado|habilitado por el|\bcip\b|registro profesional|titulado(?!\s*y/?o)"
DRIVING = r"licencia de conducir|brevete|\ba-?iib\b|movilidad propia"
ASKS_CAREER = r"ingenier[a-z]*\s+industrial|ing[.,]?\s*industrial"

# Experience.
NUMBER_WORDS = {"un": 1, "una": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9, "diez": 10, "once": 11, "doce": 12, "quince": 15}
_WORDS = "|".join(NUMBER_WORDS)
_UNIT = r"(anios?|anos?|semestres?|meses|mes)\b"
_SPAN = rf"(?<!\d)(?<![\d][.,])(\d{{1,2}}(?:[.,]5)?|{_WORDS})\b\s*(?:\+|o\s*mas|a\s*mas|en adelante)?\s*(?:de\s+)?{_UNIT}"
#: What every quantified pattern contains, and what every range ends with.
SPAN, RANGE_END = _SPAN, rf"(?:\d|{_WORDS})\s*(?:de\s+)?{_UNIT}"
#: What every span and range holds: the last of a number, and its unit.
SPAN_CORE = rf"(?:\d|{_WORDS})\s*(?:\+|o\s*mas|a\s*mas|en adelante)?\s*(?:de\s+)?(?:anios?|anos?|semestres?|meses|mes)\b"
EXPERIENCE_PATTERNS = (
    rf"experiencia\b[^.;]{{0,45}}?{_SPAN}",
    rf"{_SPAN}[^.;]{{0,25}}?experiencia",
    rf"{_SPAN}\s*(?:\(?[a-z]*\)?\s*)?(?:en|como|desempenando|realizando|liderando|ejerciendo|manejando)\b[^.;]{{0,45}}?"
    r"(?:similar|afin|relacionad|el puesto|el cargo|el rubro|el sector|roles|posicion|puesto|cargo|labores|funciones|areas|ventas|atencion|supervision)",
    rf"(?:minim[oa]|al menos|no menor a|mayor a|por lo menos|contar con|acreditar)\s*(?:de\s*)?{_SPAN}",
)
EXPERIENCE_RANGE = rf"(?<!\d)(?<![\d][.,])(\d{{1,2}}|{_WORDS})\s*(?:a|y|hasta|-|/)\s*(\d{{1,2}}|{_WORDS})\s*(?:de\s+)?{_UNIT}"
RANGE_BEFORE = ("experiencia", "minim", "al menos", "entre", "requier", "contar con", "acredit")
RANGE_AFTER = ("experiencia", "similar", "el cargo", "el puesto", "el rubro")
PORTAL_FOOTERS = (
    "show more show less", "nivel de antiguedad", "las recomendaciones duplican", "ofertas similares", "empleos similares", "denunciar empleo", "avisame con ofertas similares",
    "no te pierdas ninguna oportunidad", "inicia sesion para", "postularme postulado", "gracias por ayudarnos a mejorar", "ver oferta completa", "otras personas tambien vieron", "se el primero en inscribirte",
)
NO_EXPERIENCE = (
    r"\b(?:con\s+o\s+)?sin\s+experiencia(?:\s+(?:previa|laboral|requerida))?\b|\bno\s+(?:se\s+)?(?:requiere|requerimos|necesitas?|es\s+necesaria|solicita)\s+experiencia\b"
    r"|\bexperiencia\s+no\s+(?:indispensable|requerida|necesaria|excluyente)\b|\bno\s+indispensable\s+experiencia\b"
    r"|\bexperiencia\s+de\s+0+\s*anios?\b|\b0+\s*anios?\s+de\s+experiencia\b|\bprimer\s+empleo\b"
)
NO_EXPERIENCE_NOISE = ("nivel de antiguedad", "tipo de empleo", "otras ofertas", "ofertas similares", "aunque no tengas", "no importa si")
COMPANY_ANYWHERE = (
    r"\btrayectoria\b|en el mercado|de historia|\bfundad[oa]|de operacion(?:es)?\s+(?:continua|ininterrumpid|en el pais|en el peru)|\bbrindando\b"
    r"|de presencia|de vida institucional|anios?\s+en\s+el\s+(?:pais|peru)"
)
COMPANY_BEFORE = r"\b(?:somos|empresa|grupo|corporacion|compania|organizacion|holding|consorcio|multinacional|transnacional)\b[^.;:]{0,70}$"
COMPANY_AFTER = r"^\s*[,)]?\s*(?:desarrolla|desarrollamos|construye|construimos|brinda|brindamos|se\s+dedica|nos\s+dedicamos|opera|operamos|lidera|lideramos|impulsando\s+el\s+desarrollo)\b"
AGE_BEFORE = ("edad", "mayores de", "mayor de", "a partir de los", "menores de")
TERM_BEFORE = (
    "periodo de prueba", "luego de", "despues de", "a partir del", "duracion", "plazo de", "contrato por", "contrato de", "vigencia", "renovacion", "reemplazo por", "licencia por",
    "descanso de", "vacaciones", "garantia de", "capacitacion de", "induccion de", "por un periodo de", "temporal por", "planilla luego de", "cada",
)
TERM_AFTER = ("de prueba", "de contrato", "de vigencia", "de licencia", "de descanso", "de vacaciones", "de garantia", "de induccion", "de capacitacion", "de duracion", "de plazo", "de gracia")
UNQUANTIFIED = (
    r"experiencia\s+(?:previa|comprobada|comprobable|demostrable|acreditada|solida|amplia|minima|laboral|relevante)\b"
    r"|(?:con|contar con|acreditar|indispensable|deseable|requiere|requerimos|posea|poseer|tener)\s+experiencia\b"
    r"|experiencia\s+(?:en|como|realizando|liderando|manejando|trabajando|desempenando|gestionando)\b"
)
CUSTOMER_EXPERIENCE = (
    "experiencia del cliente", "experiencia de cliente", "experiencia al cliente", "experiencia de usuario", "experiencia de compra", "experiencia bancaria", "experiencia de marca",
    "experiencia digital", "experiencia memorable", "experiencia unica", "mejor experiencia", "vive la experiencia", "experiencia de servicio", "grata experiencia", "experiencia wow", "nuestra experiencia",
)
MAX_EXPERIENCE_MONTHS = 240
