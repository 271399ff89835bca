"""Fare arithmetic: fuel, reference price, search range and car class."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values -------------------------------------------------------------
FUEL_LITRES_PER_100KM = 9.0
FUEL_PRICE_PER_LITRE = 55.0
PROFIT_MARGIN = 1.3
BASE_FARE = 100.0
FARE_PER_KM = 15.0
FARE_PER_MINUTE = 5.0

ECONOMY_BRANDS = ["Daewoo", "Lifan", "FAW", "Great Wall", "Geely", "ЗАЗ", "Chery"]
ECONOMY_MODELS = [
    "Logan", "Symbol", "Sandero", "Lacetti", "Aveo", "Nexia", "Rio", "Spectra",
    "Granta", "Гранта", "Kalina", "Калина", "Priora", "Приора",
    "2110", "2112", "2115", "2107", "2114", "Самара", "S18",
]
BUSINESS_BRANDS = ["Toyota", "Honda", "Mitsubishi", "Subaru"]
BUSINESS_MODELS = [
    "Camry", "Corolla", "RAV4", "Avensis", "Civic", "Accord", "Qashqai", "X-Trail",
    "Tiguan", "Passat CC", "Passat", "CX-5", "Outlander", "Kyron", "Legacy",
]
# --------------------------------------------------------------------------


def kilometres(metres: Column) -> Column:
    return metres / F.lit(1000.0)


def minutes(seconds: Column) -> Column:
    return seconds / F.lit(60.0)


def fuel_litres(metres: Column, litres_per_100km: float = FUEL_LITRES_PER_100KM) -> Column:
    return kilometres(metres) * F.lit(litres_per_100km) / F.lit(100.0)


def fuel_cost(
    metres: Column,
    litres_per_100km: float = FUEL_LITRES_PER_100KM,
    price_per_litre: float = FUEL_PRICE_PER_LITRE,
) -> Column:
    return fuel_litres(metres, litres_per_100km) * F.lit(price_per_litre)


def min_profitable(cost: Column) -> Column:
    return cost * F.lit(PROFIT_MARGIN)


def reference_price(metres: Column, seconds: Column) -> Column:
    by_distance = kilometres(metres) * F.lit(FARE_PER_KM)
    by_time = minutes(seconds) * F.lit(FARE_PER_MINUTE)
    return F.lit(BASE_FARE) + by_distance + by_time


def search_bounds(start: Column, reference: Column) -> tuple[Column, Column]:
    low = F.least(start, reference * F.lit(0.5))
    high = F.greatest(reference * F.lit(3.0), start * F.lit(2.5))
    return low, high


def taxi_type(brand: Column, model: Column) -> Column:
    """Car class by exact, case-sensitive name. LADA comfort models need no case
    of their own: whatever is in neither list is comfort."""
    brand, model = F.trim(brand), F.trim(model)
    economy = brand.isin(ECONOMY_BRANDS) | model.isin(ECONOMY_MODELS)
    business = brand.isin(BUSINESS_BRANDS) | model.isin(BUSINESS_MODELS)
    return F.when(economy, "economy").when(business, "business").otherwise("comfort")
