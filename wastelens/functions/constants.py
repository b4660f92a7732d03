"""Labels, tables, thresholds and formats that results must carry as they are."""

# ---- fixed values -------------------------------------------------------------------------
CURRENCY = "S/"
WASTE_LIMIT_PCT = 15.0

WEEKDAYS = ["Lunes", "Martes", "Miércoles", "Jueves", "Viernes", "Sábado", "Domingo"]
MONTHS = [
    "Enero", "Febrero", "Marzo", "Abril", "Mayo", "Junio",
    "Julio", "Agosto", "Septiembre", "Octubre", "Noviembre", "Diciembre",
]
HOLIDAYS = ["01-01", "05-01", "06-29", "07-28", "07-29", "08-30", "10-08", "11-01", "12-08", "12-25"]

REASONS = ["sobreproducción", "vencimiento", "mala conservación", "baja demanda", "error operativo"]
UNITS = ["kg", "g", "lt", "ml", "unidad", "porción", "atado", "bandeja"]
UNITS_PER_THOUSAND = ["g", "gr", "gramo", "gramos", "ml", "mililitro", "mililitros"]

LEVEL_ORDER = {"CRITICO": 0, "ALTO": 1, "MEDIO": 2, "BAJO": 3}
STATES = ["pendiente", "leida", "resuelta"]

OVERPRODUCTION = "RIESGO_SOBREPRODUCCION"
EXPIRING = "PRODUCTO_PROXIMO_VENCER"
OVERSTOCK = "STOCK_EXCESIVO"
LOW_DEMAND = "BAJA_DEMANDA"
HIGH_WASTE = "ALTO_DESPERDICIO"
MENU = "RECOMENDACION_MENU"
CRITICAL = "ALERTA_CRITICA"
ALERT_TYPES = [OVERPRODUCTION, EXPIRING, OVERSTOCK, LOW_DEMAND, HIGH_WASTE, MENU, CRITICAL]
DISH_ALERTS = [OVERPRODUCTION, LOW_DEMAND, HIGH_WASTE, MENU, CRITICAL]

# Level cuts: below the first BAJO, below the second MEDIO, below the third ALTO, else CRITICO.
CUTS = {
    OVERPRODUCTION: (10.0, 25.0, 45.0),
    OVERSTOCK: (4.0, 6.0, 10.0),
    LOW_DEMAND: (20.0, 40.0, 65.0),
    HIGH_WASTE: (20.0, 60.0, 120.0),
    "RIESGO_PLATO": (15.0, 35.0, 60.0),
}

# kg CO2 equivalent per kg of food, in matching order (the first keyword contained in a name wins).
CO2_FACTORS = {
    "carne": 25.0, "res": 25.0, "vacuno": 25.0, "cabrito": 20.0,
    "cordero": 20.0, "cerdo": 7.6, "pollo": 6.9, "ave": 6.9,
    "pato": 6.9, "pavo": 6.9, "pescado": 3.0, "mariscos": 3.0,
    "concha": 3.0, "camaron": 3.0, "langostino": 3.0,
    "arroz": 3.0, "fideo": 1.7, "pasta": 1.7, "pan": 1.4,
    "harina": 1.4, "verdura": 2.0, "vegetal": 2.0, "hortaliza": 2.0,
    "papa": 0.5, "yuca": 0.9, "camote": 0.9, "fruta": 1.1,
    "lacteo": 3.2, "leche": 3.2, "queso": 9.8, "huevo": 4.8,
    "aceite": 3.3, "azucar": 3.0, "legumbre": 1.8, "menestra": 1.8,
    "frijol": 1.8, "lenteja": 1.8, "sal": 0.1, "aji": 1.5,
    "cebolla": 0.5, "tomate": 1.4, "ajo": 0.5, "limon": 0.9,
}
# Litres of water per kg of food, in matching order.
WATER_FACTORS = {
    "carne": 15400.0, "res": 15400.0, "vacuno": 15400.0,
    "cabrito": 10400.0, "cordero": 10400.0, "cerdo": 5990.0,
    "pollo": 4300.0, "ave": 4300.0, "pato": 4300.0,
    "pescado": 590.0, "mariscos": 590.0, "concha": 590.0,
    "arroz": 2500.0, "fideo": 1850.0, "pasta": 1850.0,
    "pan": 1600.0, "harina": 1600.0, "verdura": 322.0,
    "vegetal": 322.0, "papa": 287.0, "yuca": 500.0,
    "fruta": 962.0, "lacteo": 1000.0, "leche": 1000.0,
    "queso": 3178.0, "huevo": 3300.0, "aceite": 4000.0,
    "azucar": 1780.0, "legumbre": 4055.0, "menestra": 4055.0,
    "frijol": 4055.0, "lenteja": 4055.0, "cebolla": 272.0,
    "tomate": 214.0, "ajo": 379.0,
}
CO2_DEFAULT = 2.5
WATER_DEFAULT = 1000.0
KG_CO2_PER_TREE_YEAR = 22.0
KG_CO2_PER_CAR_KM = 0.21
LITRES_PER_SHOWER = 65.0

ACTIONS = ["ver", "crear", "editar", "eliminar", "exportar", "generar_reporte"]
ROLES = ["Administrador", "Gerente", "Trabajador", "Analista"]
PERMISSIONS = {
    "Administrador": {"todos": ["ver", "crear", "editar", "eliminar", "exportar", "generar_reporte"]},
    "Gerente": {
        "usuarios": ["ver"],
        "restaurantes": ["ver", "crear", "editar"],
        "clientes": ["ver", "crear", "editar", "exportar"],
        "proveedores": ["ver", "crear", "editar", "exportar"],
        "platos": ["ver", "crear", "editar"],
        "insumos": ["ver", "crear", "editar"],
        "recetas": ["ver", "crear", "editar"],
        "ventas": ["ver", "crear", "editar", "exportar"],
        "produccion": ["ver", "crear", "editar"],
        "desperdicio": ["ver", "crear", "editar", "exportar"],
        "prediccion": ["ver", "generar_reporte"],
        "dashboard": ["ver"],
        "reportes": ["ver", "generar_reporte", "exportar"],
        "bitacora": ["ver"],
        "configuracion": ["ver", "editar"],
    },
    "Trabajador": {
        "ventas": ["ver", "crear"],
        "produccion": ["ver", "crear"],
        "desperdicio": ["ver", "crear"],
        "insumos": ["ver"],
        "platos": ["ver"],
        "clientes": ["ver"],
        "proveedores": ["ver"],
        "dashboard": ["ver"],
    },
    "Analista": {
        "dashboard": ["ver"],
        "ventas": ["ver", "exportar"],
        "desperdicio": ["ver", "exportar"],
        "clientes": ["ver", "exportar"],
        "proveedores": ["ver", "exportar"],
        "prediccion": ["ver", "generar_reporte"],
        "estadisticas": ["ver", "exportar"],
        "reportes": ["ver", "generar_reporte", "exportar"],
        "bitacora": ["ver"],
    },
}

EMAIL_PATTERN = r"^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+$"
TAX_ID_PATTERN = r"^[0-9]{11}$"
PHONE_PATTERN = r"^[\d\s\+\-\(\)]{6,20}$"
MIN_PASSWORD = 6

STATUS_OK = "OK - Bajo control"
STATUS_ALERT = "ALERTA - Supera umbral"

WEATHER_LABELS = {1: "soleado", 2: "nublado", 3: "lluvioso"}
EVENT_LABELS = {0: "sin evento especial", 1: "evento local", 2: "feriado nacional"}

# Hyper-parameter search spaces, per model.
SEARCH_SPACES = {
    "arima": {"p": [0, 1, 2, 3], "d": [0, 1, 2], "q": [0, 1, 2, 3]},
    "tendencia": {
        "changepoint_prior_scale": [0.01, 0.05, 0.1, 0.5],
        "seasonality_prior_scale": [1.0, 5.0, 10.0, 20.0],
        "seasonality_mode": ["additive", "multiplicative"],
        "weekly_seasonality": [True, False],
    },
    "holt_winters": {
        "trend": ["add"], "damped_trend": [True, False],
        "seasonal": ["add", None], "seasonal_periods": [7],
    },
    "atencion_random_forest": {
        "n_estimators": [80, 120, 150, 200], "max_depth": [6, 8, 10, 14, None],
        "min_samples_split": [2, 5, 10], "min_samples_leaf": [1, 2, 4],
        "max_features": ["sqrt", "log2", None],
    },
    "atencion_gradient_boosting": {
        "n_estimators": [60, 100, 150], "learning_rate": [0.03, 0.05, 0.08, 0.12],
        "max_depth": [3, 4, 5], "min_samples_split": [2, 5, 10],
        "min_samples_leaf": [1, 2, 4], "subsample": [0.7, 0.85, 1.0],
    },
}
# Alert texts. Placeholders are filled by functions.text.render.
ALERT_TITLES = {
    OVERPRODUCTION: "Riesgo sobreproducción: {nombre}",
    EXPIRING: "Vence en {dias} día(s): {nombre}",
    OVERSTOCK: "Stock excesivo: {nombre}",
    LOW_DEMAND: "Baja demanda: {nombre}",
    HIGH_WASTE: "Alto desperdicio: {nombre}",
    MENU: "Sin ventas en 30 días: {nombre}",
    CRITICAL: "Alerta crítica: {nombre}",
}
ALERT_DESCRIPTIONS = {
    OVERPRODUCTION: "El {pct} % de la producción de '{nombre}' fue sobrante en los últimos 30 días "
    "({sobrante} de {preparada} unidades).",
    EXPIRING: "'{nombre}' vence el {fecha}. Stock disponible: {stock} {unidad}.",
    OVERSTOCK: "Stock de '{nombre}': {stock} {unidad} ({ratio}x el mínimo recomendado).",
    LOW_DEMAND: "Las ventas de '{nombre}' cayeron {pct} % (de {previo} a {reciente} unidades en los últimos 30 días).",
    HIGH_WASTE: "Costo de desperdicio de '{nombre}': S/ {costo} en los últimos 30 días "
    "({cantidad} unidades desperdiciadas).",
    MENU: "'{nombre}' no registra ventas en los últimos 30 días. Evaluar si debe permanecer en el menú.",
    CRITICAL: "'{nombre}' presenta baja demanda y alto costo de desperdicio simultáneamente. "
    "Requiere atención inmediata.",
}
ALERT_ADVICE = {
    OVERPRODUCTION: "Reducir la producción diaria de '{nombre}' en aproximadamente {ajuste} %. "
    "Actualmente se desperdicia el {pct} % de lo preparado. "
    "Usar el historial de ventas de los últimos 7 días como referencia.",
    EXPIRING: "Dar uso prioritario a '{nombre}' antes de {dias} día(s). Stock disponible: {stock} unidades. "
    "Incorporar como ingrediente especial del día o aplicar descuento en el menú.",
    OVERSTOCK: "El stock de '{nombre}' es {ratio}x el mínimo recomendado. "
    "Pausar pedidos al proveedor y priorizar el consumo. "
    "Revisar si hay platos que pueden incorporar este insumo en mayor cantidad.",
    LOW_DEMAND: "Las ventas de '{nombre}' cayeron {pct} % respecto al mes anterior. "
    "Evaluar una promoción, reducir precio temporalmente o mejorar presentación. "
    "Considerar reducir producción mientras se implementa la mejora.",
    HIGH_WASTE: "El costo de desperdicio de '{nombre}' fue S/ {costo} en los últimos 30 días. "
    "Revisar porciones servidas, ajustar receta y capacitar al personal. "
    "Registrar el motivo de cada desperdicio para identificar la causa raíz.",
    MENU: "'{nombre}' no registra ventas en los últimos 30 días. "
    "Considerar retirarlo del menú, actualizar su presentación o incluirlo en "
    "un combo con mayor rotación para estimular su consumo.",
    CRITICAL: "'{nombre}' presenta múltiples factores de riesgo simultáneos: baja demanda y alto desperdicio. "
    "Acción inmediata recomendada: suspender temporalmente la producción, revisar la receta y consultar "
    "con el equipo si debe mantenerse en el menú.",
}
ADVICE_CONTEXT = (
    " Considerar que el clima es {clima} y hay {evento} hoy, lo que puede {efecto} la demanda."
)

# Recommendation and dashboard texts: (title, text).
RECOMMENDATIONS = {
    "stock_bajo": ("Reponer {nombre}",
                   "Stock actual {stock} {unidad} es menor al mínimo ({minimo} {unidad}). Solicitar reposición urgente."),
    "vencimiento": ("Usar pronto: {nombre}", "Vence en {dias} día(s) ({fecha}). Priorizar su uso en producción."),
    "sobreproduccion": ("Reducir producción de {nombre}",
                        "El {pct}% de la producción de {nombre} se desperdicia. Reducir cantidad preparada diaria."),
    "motivo_desperdicio": ("Motivo frecuente: {motivo}",
                           "En los últimos 30 días ocurrió {frecuencia} veces con costo de S/ {costo}. "
                           "Implementar plan de mejora."),
}
DASHBOARD_ALERTS = {
    "stock_bajo": ("Stock bajo: {nombre}", "Stock actual: {stock} {unidad}"),
    "vencimiento": ("Por vencer: {nombre}", "Vence el {fecha}"),
}
OUTBOX_WASTE = ("Desperdicio crítico: {pct}%", "El desperdicio alcanzó {pct}% superando el umbral permitido de {umbral}%.")
# ---- end of fixed values ------------------------------------------------------------------
