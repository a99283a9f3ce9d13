"""Column names, types and lists of the flight tables.

The lists below are fixed values: they must equal the ones the reference
analysis uses (which raw columns are dismissed, which columns are the
categorical / numeric model features) for results to match.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: raw columns dismissed while cleaning -------------------------
# Note: the reference list lacks a comma between 'SecurityDelay' and
# 'CancellationCode', producing the name 'SecurityDelayCancellationCode'; both real
# names occur again later in the list, and unknown names are ignored by `drop`.
DISMISSED_RAW_COLUMNS = [
    "DepDelayMinutes", "DepDel15", "DepartureDelayGroups",
    "ArrDelayMinutes", "ArrDel15", "ArrivalDelayGroups",
    "DepTimeBlk", "ArrTimeBlk", "DestAirportID", "DestAirportSeqID",
    "DestCityMarketID", "OriginAirportID", "OriginAirportSeqID",
    "OriginCityMarketID", "Marketing_Airline_Network",
    "Flight_Number_Marketing_Airline",
    "FlightDate", "OriginWac", "DestWac", "Flights",
    "Duplicate", "OriginStateFips", "DestStateFips", "OriginState",
    "DestState",
    "DivAirportLandings", "DivReachedDest", "DivActualElapsedTime",
    "DivArrDelay", "DivDistance",
    "Div1Airport", "Div1AirportID", "Div1AirportSeqID", "Div1WheelsOn",
    "Div1TotalGTime", "Div1LongestGTime", "Div1WheelsOff", "Div1TailNum",
    "Div2Airport", "Div2AirportID", "Div2AirportSeqID", "Div2WheelsOn",
    "Div2TotalGTime", "Div2LongestGTime", "Div2WheelsOff", "Div2TailNum",
    "Div3Airport", "Div3AirportID", "Div3AirportSeqID", "Div3WheelsOn",
    "Div3TotalGTime", "Div3LongestGTime", "Div3WheelsOff", "Div3TailNum",
    "Div4Airport", "Div4AirportID", "Div4AirportSeqID", "Div4WheelsOn",
    "Div4TotalGTime", "Div4LongestGTime", "Div4WheelsOff", "Div4TailNum",
    "Div5Airport", "Div5AirportID", "Div5AirportSeqID", "Div5WheelsOn",
    "Div5TotalGTime", "Div5LongestGTime", "Div5WheelsOff", "Div5TailNum",
    "DOT_ID_Marketing_Airline", "DOT_ID_Operating_Airline", "DayofMonth",
    "IATA_Code_Marketing_Airline", "IATA_Code_Operating_Airline", "Tail_Number",
    "Cancelled", "Diverted",
    "CarrierDelay", "WeatherDelay", "NASDelay", 
    "Originally_Scheduled_Code_Share_Airline", "DOT_ID_Originally_Scheduled_Code_Share_Airline",
    "IATA_Code_Originally_Scheduled_Code_Share_Airline", "Flight_Num_Originally_Scheduled_Code_Share_Airline",
    "FirstDepTime", "TotalAddGTime", "LongestAddGTime", "_c119", "LateAircraftDelay",
    "CancellationCode", "SecurityDelay",
]

# --- fixed values: city/state parts merged into "City,State" and then dismissed --
CITY_STATE_PARTS = {
    "OriginCityNameState": ("OriginCityName", "OriginStateName"),
    "DestCityNameState": ("DestCityName", "DestStateName"),
}

# --- fixed values: clock columns stored as hhmm and converted to minutes ---------
HHMM_COLUMNS = ["DepTime", "CRSDepTime", "ArrTime", "CRSArrTime"]
# delay column -> (actual, scheduled)
DELAY_COLUMNS = {"DepDelay": ("DepTime", "CRSDepTime"), "ArrDelay": ("ArrTime", "CRSArrTime")}

# --- fixed values: the clean 26-column flight record and its types ---------------
CLEAN_SCHEMA = T.StructType([
    T.StructField("Year", T.IntegerType()),
    T.StructField("Quarter", T.IntegerType()),
    T.StructField("Month", T.IntegerType()),
    T.StructField("DayOfWeek", T.IntegerType()),
    T.StructField("Operated_or_Branded_Code_Share_Partners", T.StringType()),
    T.StructField("Operating_Airline", T.StringType()),
    T.StructField("Flight_Number_Operating_Airline", T.IntegerType()),
    T.StructField("CRSDepTime", T.IntegerType()),
    T.StructField("DepTime", T.IntegerType()),
    T.StructField("TaxiOut", T.DoubleType()),
    T.StructField("WheelsOff", T.IntegerType()),
    T.StructField("WheelsOn", T.IntegerType()),
    T.StructField("TaxiIn", T.DoubleType()),
    T.StructField("CRSElapsedTime", T.DoubleType()),
    T.StructField("ActualElapsedTime", T.DoubleType()),
    T.StructField("AirTime", T.DoubleType()),
    T.StructField("Distance", T.DoubleType()),
    T.StructField("DistanceGroup", T.IntegerType()),
    T.StructField("OriginCityNameState", T.StringType()),
    T.StructField("DestCityNameState", T.StringType()),
    T.StructField("Origin", T.StringType()),
    T.StructField("Dest", T.StringType()),
    T.StructField("DepDelay", T.IntegerType()),
    T.StructField("CRSArrTime", T.IntegerType()),
    T.StructField("ArrTime", T.IntegerType()),
    T.StructField("ArrDelay", T.IntegerType()),
])
CLEAN_COLUMNS = [f.name for f in CLEAN_SCHEMA.fields]

# --- fixed values: model features ------------------------------------------------
CATEGORICAL_FEATURES = [
    "Operated_or_Branded_Code_Share_Partners",
    "Operating_Airline",
    "Origin",
    "Dest",
    "OriginCityNameState",
    "DestCityNameState",
]

# --- fixed values: numeric inputs of the delay classifiers (arrival-side columns excluded) ---
CLASSIFIER_NUMERIC_FEATURES = [
    "Year", "Quarter", "Month", "DayOfWeek", "Flight_Number_Operating_Airline",
    "CRSDepTime", "DepTime", "TaxiOut", "WheelsOff", "Distance", "DistanceGroup",
    "AirTime", "WheelsOn", "TaxiIn", "CRSElapsedTime", "ActualElapsedTime",
]

# --- fixed values: numeric columns of the correlation matrix ---
CORRELATION_FEATURES = [
    "Year", "Quarter", "Month", "DayOfWeek", "Flight_Number_Operating_Airline",
    "CRSDepTime", "DepTime", "DepDelay", "TaxiOut", "WheelsOff", "Distance",
    "DistanceGroup", "AirTime", "CRSArrTime", "ArrTime", "ArrDelay", "WheelsOn",
    "TaxiIn", "Cancelled", "Diverted", "CRSElapsedTime", "ActualElapsedTime",
]

# --- fixed values: numeric inputs of the clustering (indexed categoricals are appended) ---
CLUSTER_NUMERIC_FEATURES = [
    "Year", "Quarter", "Month", "DayOfWeek", "Flight_Number_Operating_Airline", "CRSDepTime",
    "DepTime", "TaxiOut", "WheelsOff", "Distance", "DistanceGroup", "AirTime", "CRSArrTime",
    "ArrTime", "WheelsOn", "TaxiIn", "Cancelled", "Diverted", "CRSElapsedTime", "ActualElapsedTime",
]
CLUSTER_INDEXED_FEATURES = [
    "Origin_Index", "Dest_Index", "Operating_Airline_Index",
    "Operated_or_Branded_Code_Share_Partners_Index", "OriginCityNameState_Index",
    "DestCityNameState_Index",
]

# --- fixed values: numeric inputs of the feature-relevance forests (indexed categoricals appended) ---
RELEVANCE_NUMERIC_FEATURES = [
    "CRSDepTime", "DepTime", "TaxiOut", "WheelsOff", "WheelsOn", "TaxiIn",
    "CRSArrTime", "ArrTime", "AirTime", "Distance", "CRSElapsedTime", "ActualElapsedTime",
    "Year", "Quarter", "Month", "DayOfWeek",
]

# --- fixed values: columns hidden from a model that predicts the arrival delay of a live flight ---
STREAM_HIDDEN_COLUMNS = ["DepDelay", "ArrDelay", "Tem_ArrDelay", "CRSArrTime", "ArrTime"]

# --- fixed values: columns removed before the linear SVM (leak / duplicate the label) ---
SVM_DROPPED_COLUMNS = ["Operated_or_Branded_Code_Share_Partners", "DepDelay", "ArrDelay",
                       "ArrTime", "TaxiIn", "WheelsOn"]

# --- fixed values: display names of codes ----------------------------------------
DELAY_LABEL_NAMES = {0: "Não", 1: "Sim"}
WEEKDAY_NAMES = {1: "Segunda", 2: "Terça", 3: "Quarta", 4: "Quinta", 5: "Sexta", 6: "Sábado", 7: "Domingo"}

# --- fixed values: thresholds (minutes) of the binary delay labels --------------
DELAY_THRESHOLD_CHARTS = 15   # charts, logistic regression, SVM
DELAY_THRESHOLD_STREAM = 5    # random forest and the live stream
