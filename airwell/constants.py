"""Fixed values.

Everything in this module must equal the values of the system we reproduce
for results to agree: weights, cut-offs, texts, colours and probabilities.
They are listed here plainly, together, in their natural order.
"""

from __future__ import annotations

# --- fixed values: pollen types, in scoring order ----------------------------
POLLENS = ["alder_pollen", "birch_pollen", "grass_pollen", "mugwort_pollen", "olive_pollen", "ragweed_pollen"]

# --- fixed values: pollen weights for the Pollen Exposure Index --------------
POLLEN_WEIGHTS = {
    "alder_pollen": 1.0,
    "birch_pollen": 1.5,
    "grass_pollen": 1.2,
    "mugwort_pollen": 1.3,
    "olive_pollen": 1.0,
    "ragweed_pollen": 1.4,
}

# --- fixed values: Air Quality Impact Index (column, divisor, multiplier) -----
AQII_TERMS = [
    ("pm10", 50.0, 50.0),
    ("pm2_5", 25.0, 50.0),
    ("nitrogen_dioxide", 40.0, 40.0),
    ("sulphur_dioxide", 20.0, 20.0),
    ("carbon_monoxide", 10.0, 10.0),
    ("ozone", 120.0, 120.0),
]

# --- fixed values: personal risk weights -------------------------------------
RISK_WEIGHTS = {"pollen": 1.0, "aqi": 1.5, "pm10": 1.0, "pm2_5": 1.3, "ozone": 1.2}
ALLERGY_FACTOR = 1.5
# condition flag -> multiplier, applied in this order
CONDITION_FACTORS = [("asthma_allergy", 1.3), ("hay_fever", 1.1), ("eczema", 1.05), ("cad", 1.2)]
RISK_DIVISOR = 15.0
CERI_DIVISOR = 2000.0
OZONE_REFERENCE = 120.0
PMHI_WEIGHTS = (0.4, 0.6)

# --- fixed values: recommendation texts --------------------------------------
GENERAL_MILD = "General: You might experience mild symptoms."
GENERAL_MODERATE = "General: You might experience moderate symptoms. Be cautious."
GENERAL_SEVERE = "General: You might experience severe symptoms. Avoid exposure if possible."
GENERAL_CUTS = (0.3, 0.7)

POLLEN_LOW = ": Low pollen levels detected. You might experience mild symptoms."
POLLEN_MODERATE = (": Moderate pollen levels detected. You might experience moderate symptoms. "
                   "Consider taking antihistamines.")
POLLEN_HIGH = ": High pollen levels detected. Consider staying indoors and take necessary precautions."
CONDITION_CUTS = (0.5, 0.8)

ASTHMA_TEXTS = (
    "Asthma: Low risk detected. Keep your inhaler handy, but you might not experience severe symptoms.",
    "Asthma: Moderate risk detected. Use your inhaler as needed and avoid strenuous activities.",
    "Asthma: High risk detected. Limit outdoor activities, have your inhaler accessible, and consider staying indoors.",
)
HAY_FEVER_TEXTS = (
    "Hay Fever: Low risk detected. Symptoms might be mild.",
    "Hay Fever: Moderate risk detected. Take antihistamines and limit outdoor exposure.",
    "Hay Fever: High risk detected. Stay indoors if possible and take antihistamines.",
)
ECZEMA_TEXTS = (
    "Eczema: Low risk of skin irritation. Keep your skin moisturized and avoid known irritants.",
    "Eczema: Moderate risk of skin irritation. Moisturize frequently and avoid exposure to high pollen areas.",
    "Eczema: High risk of severe skin irritation. Stay indoors, moisturize often, and avoid known irritants.",
)
CARDIAC_TEXT = ("Cardiac Health: High risk of exacerbation due to poor air quality. Avoid outdoor exertion, "
                "monitor your heart condition, and consult your doctor if necessary.")
HEART_HIGH_TEXT = "Heart rate: Your heart rate is elevated. Consider taking a deep breath or a short break."
HEART_LOW_TEXT = "Heart rate: Your heart rate is unusually low. If you feel unwell, consult a doctor."
SKIN_TEXT = "Illness: Your skin temperature is high. Hydrate, rest, and monitor for illness symptoms."
ACTIVITY_TEXT = "Activity: You are highly active. Cool down and stay hydrated."
STRESS_TEXT = "Stress: You might be experiencing stress. Consider taking a short walk or relaxing."

# --- fixed values: wearable cut-offs -----------------------------------------
HEART_HIGH, HEART_HIGH_ACTIVITY, HEART_LOW = 100.0, 0.3, 50.0
SKIN_HIGH = 37.5
ACTIVE_HR, ACTIVE_EDA, ACTIVE_LEVEL = 120.0, 9.8, 0.7
STRESS_HR, STRESS_EDA, STRESS_LEVEL = 99.0, 9.9, 0.3

# --- fixed values: pollen classes (inclusive upper bounds) and colours -------
POLLEN_CLASS_BOUNDS = {
    "Alder": (15.0, 90.0, 1500.0),
    "Birch": (15.0, 90.0, 1500.0),
    "Grass": (5.0, 20.0, 200.0),
    "Mugwort": (10.0, 50.0, 500.0),
    "Olive": (15.0, 90.0, 1500.0),
    "Ragweed": (10.0, 50.0, 500.0),
}
POLLEN_LEVELS = ["Low", "Moderate", "High", "Very High"]
UNKNOWN_POLLEN_LABEL = "Unknown Pollen Type or Invalid Concentration"
LEVEL_COLOURS = {"Low": "#00FF00", "Moderate": "#FFFF00", "High": "#FFA500", "Very High": "#FF0000"}
UNKNOWN_COLOUR = "#808080"
NO_DATA_COLOUR = "#000000"

# --- fixed values: spatial ---------------------------------------------------
EARTH_RADIUS_KM = 6371.0088
NEAREST_RADIUS_KM = 10000.0
SITE_KEY_PREFIX = "municipality:"

# --- fixed values: cohort probabilities (as coded) ---------------------------
PROB_ECZEMA = 0.40
PROB_ASTHMA_WITH_HISTORY = 0.60
PROB_ASTHMA = 0.0671
PROB_POLLEN_GATE = 0.40
# pollen allergy base rates, in the order they are drawn
POLLEN_BASE_RATES = [
    ("ragweed_pollen_allergy", 0.0738),
    ("grass_pollen_allergy", 0.0527),
    ("mugwort_pollen_allergy", 0.0527),
    ("birch_pollen_allergy", 0.125),
    ("alder_pollen_allergy", 0.08),
    ("olive_pollen_allergy", 0.07),
]
# hay fever repair picks one of these, uniformly
HAY_FEVER_PICK_ORDER = [
    "ragweed_pollen_allergy", "grass_pollen_allergy", "mugwort_pollen_allergy",
    "birch_pollen_allergy", "alder_pollen_allergy", "olive_pollen_allergy",
]
OBESITY_BMI = 25.0
