"""Fixed vocabularies of the tool-log domain.

Everything in this module is a fixed value: word lists, lookup tables, constants and
patterns whose content decides the results.  They are kept here as plain data so the
operators contain no literals of their own.
"""

# --------------------------------------------------------------------------------------
# Canonical record types, allowed target fields, destination tables.
# --------------------------------------------------------------------------------------
PARSER_VERSION = "mvp_v1"

CANONICAL_TYPES = [
    "equipment_state",
    "process_parameter_recipe",
    "sensor_reading",
    "fault_event",
    "wafer_processing_sequence",
    "generic_operational_observation",
]

CANONICAL_FIELDS = [
    "tool_id", "timestamp", "wafer", "lot", "slot", "recipe", "step", "parameter", "value",
    "unit", "sensor_id", "curr_state", "prev_state", "event_name", "fault_code",
    "fault_summary", "severity", "status", "action", "duration_s", "wafer_count",
    "expected_value", "measured_value", "component", "module_id", "recipe_step_id",
    "operator_id", "process_job_id", "control_job_id", "equipment_class", "to_state",
    "from_state", "record_id",
]

TABLE_OF_TYPE = {
    "equipment_state": "equipment_states",
    "process_parameter_recipe": "process_parameters_recipes",
    "sensor_reading": "sensor_readings",
    "fault_event": "fault_events",
    "wafer_processing_sequence": "wafer_processing_sequences",
    "generic_operational_observation": "generic_observations_staging",
}

# Parser record type -> canonical type (the last entry maps the detected sensor CSV shape).
TYPE_OF_SOURCE = {
    "process_job": "wafer_processing_sequence",
    "module_process_report": "wafer_processing_sequence",
    "sensor_measurement": "sensor_reading",
    "alarm_event": "fault_event",
    "error_event": "fault_event",
    "control_state_event": "equipment_state",
    "csv_row": "sensor_reading",
    "sensor_measurement_csv": "sensor_reading",
}

# Canonical type of a record called "event", by its upper-cased @type.
TYPE_OF_EVENT_ATTRIBUTE = {
    "STATE": "equipment_state",
    "STEP": "wafer_processing_sequence",
    "SENSOR": "sensor_reading",
    "ALARM": "fault_event",
}

# Identifier-like fields whose text must survive scalar coercion untouched.
ID_FIELDS = [
    "tool_id", "wafer", "lot", "slot", "recipe", "step", "sensor_id", "fault_code",
    "record_id", "operator_id", "process_job_id", "control_job_id", "module_id",
    "recipe_step_id",
]

# --------------------------------------------------------------------------------------
# Standard field -> accepted spellings, in precedence order.
# --------------------------------------------------------------------------------------
FIELD_ALIASES = {
    "tool_id": ["tool_id", "tool", "machine", "equip_id", "equipment_id", "equipment",
                "toolname", "tool_name", "controljob.equipmentid", "keys.moduleid", "@tool",
                "eventlog.@toolid", "eqp_name"],
    "timestamp": ["timestamp", "time", "ts", "timestamp_hours", "time_h", "approx_time",
                  "timestamp_approx", "event_time", "datetime", "@ts", "sample_ts"],
    "wafer": ["wafer", "wafer_id", "unit_id", "item_id", "material_id", "wfr",
              "controljob.processjobs[].waferid", "keys.waferid",
              "controljob.processjobs[].moduleprocessreports[].keys.waferid", "@wafer",
              "wfr_ref", "waferid", "keyswaferid"],
    "lot": ["lot", "lot_id", "controljob.processjobs[].lotid", "eventlog.@lotid", "lot_ref",
            "lotid"],
    "parameter": ["parameter", "measurement", "measurement_name", "metric", "sensor",
                  "controljob.processjobs[].moduleprocessreports[].sensordata[].sensorname",
                  "param"],
    "value": ["value", "measured_value", "reading", "eng_val"],
    "unit": ["unit", "units",
             "controljob.processjobs[].moduleprocessreports[].sensordata[].unit", "uom"],
    "curr_state": ["curr_state", "state", "new_state", "system_state", "equipment_state",
                   "status", "@currst"],
    "prev_state": ["prev_state", "from_state", "previous_state", "@prevst"],
    "event_name": ["event_name", "event", "text", "@msg", "@action", "name"],
    "step": ["step", "process_step", "recipestepname", "attributes.recipestepname", "@step",
             "process_stage"],
    "fault_code": ["fault_code", "error_code", "alarm_code", "code", "alarmid", "errorid"],
    "fault_summary": ["fault_summary", "fault_description", "message", "issue", "text",
                      "@msg"],
    "recipe": ["recipe", "recipename", "attributes.recipename", "eventlog.@recipeid",
               "recipeid", "recipe.recipeid"],
    "slot": ["slot", "slotid", "attributes.slotid"],
    "severity": ["severity", "qc_flag"],
    "sensor_id": ["sensorid", "keys.sensorid"],
}

# --------------------------------------------------------------------------------------
# Unit suffixes inside field names (temp_F, flow_mL_min) -> unit symbol.
# --------------------------------------------------------------------------------------
UNIT_SUFFIXES = {
    "c": "degC", "degc": "degC", "f": "degF", "degf": "degF", "k": "K",
    "pa": "Pa", "kpa": "kPa", "mpa": "MPa", "bar": "bar", "mbar": "mbar", "atm": "atm",
    "psi": "psi", "torr": "Torr", "mtorr": "mTorr", "mmhg": "mmHg",
    "ns": "ns", "us": "us", "ms": "ms", "s": "s", "sec": "s", "min": "min", "h": "h",
    "hr": "h",
    "rpm": "rpm", "rps": "rps", "rads": "rad/s",
    "n": "N", "kn": "kN", "lbf": "lbf",
    "sccm": "sccm", "slm": "slm", "ccmin": "cc/min", "mlmin": "mL/min", "mls": "mL/s",
    "lmin": "L/min", "lh": "L/h",
    "w": "W", "kw": "kW", "mw": "mW",
    "hz": "Hz", "khz": "kHz", "mhz": "MHz", "ghz": "GHz",
    "m": "m", "cm": "cm", "mm": "mm", "um": "um", "nm": "nm", "a": "A",
    "kg": "kg", "g": "g", "mg": "mg", "ug": "ug",
    "pct": "%", "percent": "%", "fraction": "fraction",
}

PARAMETER_TOKEN_WORDS = {
    "temp": "temperature",
    "tmp": "temperature",
    "press": "pressure",
    "spd": "speed",
    "dur": "duration",
    "freq": "frequency",
}

# --------------------------------------------------------------------------------------
# Unit spellings (lower case, no spaces) -> unit symbol.
# --------------------------------------------------------------------------------------
UNIT_ALIASES = {
    "c": "degC", "degc": "degC", "°c": "degC", "celsius": "degC",
    "f": "degF", "degf": "degF", "°f": "degF", "fahrenheit": "degF",
    "k": "K", "kelvin": "K",
    "pa": "Pa", "kpa": "kPa", "mpa": "MPa", "bar": "bar", "mbar": "mbar", "atm": "atm",
    "psi": "psi", "torr": "Torr", "mtorr": "mTorr", "mmhg": "mmHg",
    "s": "s", "sec": "s", "secs": "s", "second": "s", "seconds": "s",
    "ms": "ms", "millisecond": "ms", "milliseconds": "ms",
    "us": "us", "µs": "us", "microsecond": "us", "microseconds": "us", "ns": "ns",
    "min": "min", "mins": "min", "minute": "min", "minutes": "min",
    "h": "h", "hr": "h", "hrs": "h", "hour": "h", "hours": "h",
    "rpm": "rpm", "rps": "rps", "rev/s": "rps", "rad/s": "rad/s",
    "n": "N", "kn": "kN", "lbf": "lbf",
    "sccm": "sccm", "slm": "slm", "cc/min": "cc/min",
    "ml/min": "mL/min", "ml/s": "mL/s", "l/min": "L/min", "l/h": "L/h",
    "w": "W", "kw": "kW", "mw": "mW",
    "hz": "Hz", "khz": "kHz", "mhz": "MHz", "ghz": "GHz",
    "m": "m", "cm": "cm", "mm": "mm", "um": "um", "µm": "um", "nm": "nm",
    "a": "A", "å": "A", "angstrom": "A",
    "kg": "kg", "g": "g", "mg": "mg", "ug": "ug", "µg": "ug", "lb": "lb",
    "%": "%", "percent": "%", "pct": "%", "fraction": "fraction",
}

# Parameter-name hints, first match wins, searched case-insensitively.
FAMILY_HINTS = [
    ("temperature", "temp|temperature|heater|chamber_temp|chuck_temp|platen_tmp"),
    ("pressure", "press|pressure|vacuum"),
    ("time", "dur|duration|time|dwell|latency"),
    ("rotational_speed", "rpm|speed|carrier_spd|platen_spd|spindle"),
    ("force", "force|down_force|load"),
    ("gas_flow", "gas_flow|n2_flow|ar_flow|o2_flow|h2_flow|mfc"),
    ("liquid_flow", "slurry_flow|di_flow|water_flow|liquid_flow|coolant_flow"),
    ("power", "power|watt"),
    ("frequency", "freq|frequency"),
    ("thickness", "thickness|etch_depth|deposition|removal"),
    ("length", "length|distance|gap|height|width|travel"),
    ("mass", "mass|weight"),
    ("percentage", "humidity|yield|efficiency|utilization|percent|ratio"),
]

# Per family the canonical unit, and per accepted unit the affine
# conversion ((x - shift) * factor) / divisor.
CONVERSIONS = {
    "temperature": ("degC", {
        "degC": (0.0, 1.0, 1.0),
        "degF": (32.0, 5.0, 9.0),
        "K": (273.15, 1.0, 1.0),
    }),
    "pressure": ("Pa", {
        "Pa": (0.0, 1.0, 1.0),
        "kPa": (0.0, 1000.0, 1.0),
        "MPa": (0.0, 1000000.0, 1.0),
        "bar": (0.0, 100000.0, 1.0),
        "mbar": (0.0, 100.0, 1.0),
        "atm": (0.0, 101325.0, 1.0),
        "psi": (0.0, 6894.757293168, 1.0),
        "Torr": (0.0, 133.32236842105263, 1.0),
        "mTorr": (0.0, 0.13332236842105263, 1.0),
        "mmHg": (0.0, 133.32236842105263, 1.0),
    }),
    "time": ("s", {
        "s": (0.0, 1.0, 1.0),
        "ms": (0.0, 1.0, 1000.0),
        "us": (0.0, 1.0, 1000000.0),
        "ns": (0.0, 1.0, 1000000000.0),
        "min": (0.0, 60.0, 1.0),
        "h": (0.0, 3600.0, 1.0),
    }),
    "rotational_speed": ("rpm", {
        "rpm": (0.0, 1.0, 1.0),
        "rps": (0.0, 60.0, 1.0),
        "rad/s": (0.0, 60.0, 6.283185307179586),
    }),
    "force": ("N", {
        "N": (0.0, 1.0, 1.0),
        "kN": (0.0, 1000.0, 1.0),
        "lbf": (0.0, 4.4482216152605, 1.0),
    }),
    "gas_flow": ("sccm", {
        "sccm": (0.0, 1.0, 1.0),
        "slm": (0.0, 1000.0, 1.0),
        "cc/min": (0.0, 1.0, 1.0),
    }),
    "liquid_flow": ("mL/min", {
        "mL/min": (0.0, 1.0, 1.0),
        "mL/s": (0.0, 60.0, 1.0),
        "L/min": (0.0, 1000.0, 1.0),
        "L/h": (0.0, 16.666666666666668, 1.0),
    }),
    "power": ("W", {
        "W": (0.0, 1.0, 1.0),
        "kW": (0.0, 1000.0, 1.0),
        "mW": (0.0, 1.0, 1000.0),
    }),
    "frequency": ("Hz", {
        "Hz": (0.0, 1.0, 1.0),
        "kHz": (0.0, 1000.0, 1.0),
        "MHz": (0.0, 1000000.0, 1.0),
        "GHz": (0.0, 1000000000.0, 1.0),
    }),
    "length": ("m", {
        "m": (0.0, 1.0, 1.0),
        "cm": (0.0, 1.0, 100.0),
        "mm": (0.0, 1.0, 1000.0),
        "um": (0.0, 1.0, 1000000.0),
        "nm": (0.0, 1.0, 1000000000.0),
        "A": (0.0, 1e-10, 1.0),
    }),
    "thickness": ("nm", {
        "nm": (0.0, 1.0, 1.0),
        "um": (0.0, 1000.0, 1.0),
        "mm": (0.0, 1000000.0, 1.0),
        "m": (0.0, 1000000000.0, 1.0),
        "A": (0.0, 0.1, 1.0),
    }),
    "mass": ("kg", {
        "kg": (0.0, 1.0, 1.0),
        "g": (0.0, 1.0, 1000.0),
        "mg": (0.0, 1.0, 1000000.0),
        "ug": (0.0, 1.0, 1000000000.0),
        "lb": (0.0, 0.45359237, 1.0),
    }),
    "percentage": ("%", {
        "%": (0.0, 1.0, 1.0),
        "fraction": (0.0, 100.0, 1.0),
    }),
}

# Families a bare unit implies (thickness shares its units with length).
# Which family a unit belongs to when several take it, in order.
UNIT_FAMILY_ORDER = [
    "temperature", "pressure", "time", "rotational_speed", "force", "gas_flow",
    "liquid_flow", "power", "frequency", "length", "mass", "percentage",
]

# --------------------------------------------------------------------------------------
# What makes a normalized record acceptable, per canonical type.
# --------------------------------------------------------------------------------------
# Source keys that fill an absent field, in order.
HARMONIZED = {
    "curr_state": ["new_state", "to_state", "event_name"],
    "prev_state": ["from_state"],
    "parameter": ["measurement_name", "sensor_id"],
    "value": ["measured_value"],
    "unit": ["units"],
}

MIN_CONFIDENCE = 0.5
MIN_GENERIC_FIELDS = 3
ACCEPT_RULES = {
    "equipment_state": (["curr_state"], "missing_curr_state"),
    "process_parameter_recipe": (
        ["recipe", "parameter", "steps", "energy_keV", "dose_cm-2", "dose_cm2", "target_value"],
        "missing_recipe_or_parameter_content"),
    "fault_event": (
        ["fault", "fault_code", "fault_summary", "issue", "threshold", "condition",
         "event_name"],
        "missing_fault_signal"),
    "wafer_processing_sequence": (
        ["wafer", "lot", "step", "action", "event_name", "status", "disposition",
         "wafer_count"],
        "missing_sequence_signal"),
}

ROUTE_TOOL_KEYS = ["tool_id", "tool", "equipment", "machine"]
SINK_TOOL_KEYS = ["tool_id", "equipment_id", "equipment_name", "tool", "eqp"]
SINK_TIME_KEYS = ["timestamp", "event_ts", "ts", "datetime", "time"]
NOTE_KEYS = ["event_name", "fault_summary", "status"]
DEFAULT_NOTE = "generic observation"

# --------------------------------------------------------------------------------------
# Format detection.
# --------------------------------------------------------------------------------------
DELIMITERS = [",", ";", "\t", "|"]
SNIFF_DELIMITERS = [",", "\t", ";", "|"]
SYSLOG_LINE = r"^\w{3}\s+\d{1,2}\s\d{2}:\d{2}:\d{2}|^\d{4}-\d{2}-\d{2}"
KV_LINE = r"\b[A-Za-z_][A-Za-z0-9_]*\s*=\s*[^=\s]+"

# format -> (parser family, support status)
FORMAT_SUPPORT = {
    "json": ("structured_parser", "supported"),
    "csv": ("structured_parser", "supported"),
    "xml": ("structured_parser", "supported"),
    "syslog_like_text": ("semi_structured_parser", "supported"),
    "key_value_text": ("semi_structured_parser", "supported"),
    "free_text_log": ("unstructured_parser", "supported"),
    "hex_dump_text": ("unstructured_parser", "supported"),
    "opaque_binary": ("binary_parser", "partially_supported"),
}

# Line-family scoring.
FAMILY_TS_PREFIX = (
    r"^\s*(?:\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})?"
    r"|[A-Z][a-z]{2}\s+\d{1,2}\s\d{2}:\d{2}:\d{2})")
FAMILY_KV = r"\b[\w.-]+=[^\s]+"
FAMILY_FACILITY = (
    r"(?i)\b[A-Za-z0-9_.-]+\.(?:debug|info|notice|warn|warning|error|critical|alert|emerg|fatal):")
FAMILY_TAG = r"\[[^\]]+\]"
FAMILY_LEVELS = "INFO|WARN|WARNING|ERROR|CRITICAL"

# --------------------------------------------------------------------------------------
# Line and block log patterns.
# --------------------------------------------------------------------------------------
KV_PAIR = r'([\w.-]+)=(".*?"|[^\s]+)'
LABEL_VALUE = r"^\s*([A-Za-z0-9_.-]+)\s*:\s*(.+?)\s*$"
SYSLOG_TS = r"^\s*([A-Z][a-z]{2}\s+\d{1,2}\s\d{2}:\d{2}:\d{2})\s+(.+)$"
ISO_TS = (
    r"^\s*((?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2})[T\s]\d{2}:\d{2}:\d{2}(?:\.\d+)?"
    r"(?:Z|[+-]\d{2}:?\d{2})?)\s+(.+)$")
HOST_FACILITY = r"^(\S+)\s+([A-Za-z0-9_.-]+)\.([A-Za-z0-9_.-]+):\s*(.*)$"
BRACKET_TOOL = r"^\[([^\]]+)\]\s+([A-Z]+)\s*:\s*([A-Z0-9_]+)\s*>\s*(.*)$"
TOOL_SEVERITY = (
    r"(?i)^(\S+)\s+(DEBUG|DBG|INFO|INF|NOTICE|WARN|WARNING|ERROR|ERR|CRITICAL|ALERT|EMERG|FATAL)"
    r"\s+(.*)$")
CONTEXT_HEADER = (
    r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?)\s+Machine:(\S+)\s+(\(.*\))$")
CONTEXT_EVENT = r"^([A-Z ]+):\s+(ER-[A-Z0-9-]+)\s+([A-Z_]+)$"
BRACKET_EVENT = r"^\[([^\]]+)\]\s*(.*)$"
GT_EVENT = r"^([A-Z][A-Z0-9_]+)\s*>\s*(.*)$"
UPPER_EVENT = r"^([A-Z][A-Z0-9_]+)\s+(.*)$"

LAYOUT_WEIGHTS = {
    "syslog_host_facility_level": 3,
    "bracket_tool_severity_event": 4,
    "tool_severity_message": 2,
    "tool_token_message": 1,
    "none": 4,
}

CLASSIFICATION_PRIORITY = [
    "fault_event", "equipment_state", "process_parameter_recipe", "sensor_reading",
    "wafer_processing_sequence", "generic_text_record",
]

# record type -> (event codes, fields of which any one is enough)
CLASSIFICATION_HINTS = {
    "equipment_state": (
        ["STATE", "EQUIP_STATE", "SYS_BOOT", "STARTUP", "SHUTDOWN"],
        ["prev", "curr", "state", "from", "to", "from_state", "to_state", "trigger"]),
    "process_parameter_recipe": (
        ["RCP_LOAD", "RCP_PARAM", "RECIPE", "RECIPE_STEP", "LOT_OPEN"],
        ["recipe", "recipe_id", "name", "rev", "parameter", "setpoint", "target_temp_C",
         "duration_s", "version"]),
    "sensor_reading": (
        ["SENSOR", "TRACE", "READING", "MEASURE"],
        ["sensor", "sensor_id", "value", "reading", "temp_C", "pressure_mTorr",
         "base_pres_Pa", "proc_pres_Pa", "dep_rate_A_s", "zone"]),
    "fault_event": (
        ["WARN", "WARNING", "ALARM", "FAULT", "FAULT_CLEAR", "ALARM_CLR", "ERROR", "ERR",
         "CRITICAL", "INTERLOCK"],
        ["fault", "fault_code", "alarm_code", "code", "error_code", "reason"]),
    "wafer_processing_sequence": (
        ["WAFER", "STEP", "STEP_START", "STEP_END", "STEP_ABORT", "WFR_SEQ", "WF_MOVE",
         "ACTION", "LOAD_COMPLETE", "UNLOAD_COMPLETE", "LOT_IN", "LOT_OUT", "LOT_RESUME",
         "MAINT"],
        ["wafer", "wafer_id", "wfr", "step", "step_name", "seq", "action", "slot", "lot"]),
    "generic_text_record": ([], []),
}

# Explicit event codes, tried in this order after the hints' event codes.
STATE_CODES = ["STATE", "EQUIP_STATE", "STATE_CHANGE", "SYS_BOOT", "STARTUP", "SHUTDOWN"]
RECIPE_CODES = ["RECIPE", "RECIPE_DEFINE", "RECIPE_STEP", "RECIPE_LOADED", "RCP_LOAD",
                "RCP_PARAM"]
SENSOR_CODES = ["SENSOR", "TRACE", "READING", "MEASURE", "PERIODIC"]
FAULT_CODES = ["ALARM", "FAULT", "ALARM_CLR", "ALARM_CLEARED", "FAULT_CLEAR", "INTERLOCK"]
LATE_FAULT_CODES = ["SRC_PWR_DROOP", "ALARM_CLEARED"]
PREFIX_FAULT_CODES = ["ALARM_CLEARED", "STEP_ABORT", "STATE_CHANGE"]
SEQUENCE_CODES = [
    "WAFER", "WAFER_LOAD", "WAFER_RESULT", "WAFER_LOADED", "WAFER_UNLOADED", "STEP",
    "STEP_START", "STEP_END", "STEP_ABORT", "WFR_SEQ", "WF_MOVE", "ACTION", "LOAD_COMPLETE",
    "UNLOAD_COMPLETE", "LOT_IN", "LOT_OUT", "LOT_RESUME", "LOT_START", "MAINT",
]
FAULT_FIELDS = ["fault", "reason", "alarm_code", "code"]
SEVERE_LEVELS = ["ERROR", "ERR", "CRITICAL", "ALERT", "EMERG", "FATAL", "WRN", "WARN",
                 "WARNING"]
STATE_FIELDS = ["from", "to", "prev", "curr", "state", "from_state", "to_state"]
RECIPE_FIELDS = ["recipe", "recipe_id", "name", "rev", "parameter", "setpoint",
                 "target_temp_C", "version"]
SENSOR_FIELDS = ["sensor", "sensor_id", "value", "reading", "temp_C", "pressure_mTorr",
                 "base_pres_Pa", "proc_pres_Pa", "dep_rate_A_s", "src_pwr_W", "vac_Pa",
                 "dose_actual_mJcm2"]
SEQUENCE_FIELDS = ["wafer", "wafer_id", "wfr", "step", "step_name", "seq", "action", "slot",
                   "lot"]

# --------------------------------------------------------------------------------------
# Structured extraction.
# --------------------------------------------------------------------------------------
DISCRIMINATORS = ["record_class", "event_type", "type", "category", "kind"]
SPLIT_PREFERRED_HEAD = ["record_id", "log_time"]
SPLIT_PREFERRED_TAIL = [
    "tool", "lot", "wafer", "step_name", "step_action", "step_seq", "step_result",
    "duration_s", "sensor_id", "measurand", "value", "unit", "alarm_id", "severity",
    "message", "from_state", "to_state", "operator", "notes",
]
SENSOR_TABLE_REQUIRED = ["timestamp", "sensor_id", "parameter", "unit"]
SENSOR_TABLE_COLUMNS = ["timestamp", "sensor_id", "parameter", "value", "unit"]
SENSOR_TABLE_OPTIONAL = ["tool_id", "chamber", "lot_id", "wafer_id", "recipe_step"]

# canonical field -> path spellings, for mapping suggestions
MAPPING_ALIASES = {
    "control_job_id": ["ControlJobID", "control_job_id"],
    "equipment_id": ["EquipmentID", "ToolID", "MachineID", "tool_id", "equipment_id"],
    "operator_id": ["OperatorID", "operator_id"],
    "process_job_id": ["PRJobID", "ProcessJobID", "process_job_id"],
    "lot_id": ["LotID", "LOTID", "lot_id"],
    "wafer_id": ["WaferID", "wafer_id"],
    "slot_id": ["SlotID", "slot_id"],
    "recipe_name": ["RecipeName", "Recipe.RecipeID", "RecipeID", "recipe_name"],
    "recipe_step_name": ["RecipeStepName", "Recipe.Type", "RecipeStepID",
                         "recipe_step_name"],
    "module_id": ["ModuleID", "module_id"],
    "sensor_id": ["SensorID", "Keys.SensorID", "sensor_id"],
    "sensor_name": ["SensorName", "sensor_name"],
    "timestamp": ["DateTime", "Timestamp", "TimeStamp", "timestamp"],
    "message": ["Text", "Message", "Name", "message"],
    "severity": ["Severity", "severity"],
    "value": ["Value", "value"],
    "unit": ["Unit", "unit"],
    "threshold": ["Threshold", "threshold"],
}

# --------------------------------------------------------------------------------------
# Built-in adapter defaults.
# --------------------------------------------------------------------------------------
DEFAULT_TYPE_MAPPING = {
    "process_job": "wafer_processing_sequence",
    "sensor_measurement": "sensor_reading",
    "alarm_event": "fault_event",
    "error_event": "fault_event",
    "control_state_event": "equipment_state",
    "process_step": "wafer_processing_sequence",
    "wafer": "wafer_processing_sequence",
    "wafer_measurement": "sensor_reading",
    "recipe_param": "process_parameter_recipe",
    "setpoint": "process_parameter_recipe",
    "fault_summary": "fault_event",
    "equipment_state_transition": "equipment_state",
}
STEP_CSV_TYPE_MAPPING = {"csv_row": "wafer_processing_sequence"}

JSON_ALIASES = {
    "LotID": "lot", "WaferID": "wafer", "SlotID": "slot", "Recipe.RecipeID": "recipe",
    "RecipeName": "recipe", "RecipeStepName": "step", "DateTime": "timestamp",
    "Value": "value", "Unit": "unit", "Text": "event_name", "Name": "event_name",
    "SensorID": "sensor_id", "SensorName": "parameter", "AlarmID": "fault_code",
    "ErrorID": "fault_code", "Severity": "severity",
    "ControlJob.EquipmentID": "tool_id", "EquipmentID": "tool_id", "ToState": "to_state",
    "FromState": "from_state",
}
EVENT_CSV_ALIASES = {
    "EventDateTime": "timestamp", "EquipmentName": "tool_id", "AlarmCode": "fault_code",
    "AlarmLevel": "severity", "AlarmDescription": "fault_summary",
    "AffectedComponent": "component", "MeasuredValue": "value",
    "ExpectedValue": "expected_value", "MeasureUnit": "unit", "LotNumber": "lot",
    "WaferNumber": "wafer", "AutoResponse": "action",
}
STEP_CSV_ALIASES = {
    "tool_id": "tool_id", "lot_id": "lot", "wafer_id": "wafer", "slot_no": "slot",
    "recipe_name": "recipe", "step_name": "step", "step_status": "status",
    "duration_s": "duration_s",
}
XML_ALIASES = {
    "@sensor": "parameter", "@timestamp": "timestamp", "@unit": "unit", "@value": "value",
    "@name": "parameter", "@u": "unit", "@v": "value", "@stepName": "step",
    "StepOutcome": "status", "FabricationRecord.ProductionOrder.LotID": "lot",
    "FabricationRecord.Hdr.Lot": "lot",
    "FabricationRecord.Equipment.EquipmentID": "tool_id", "RcpExecLog.@eqp": "tool_id",
    "RcpExecLog.Hdr.Lot": "lot", "RcpExecLog.Hdr.Rcp": "recipe",
    "RcpExecLog.WfrLog.W[].@id": "wafer", "@id": "wafer", "@n": "slot",
    "@cd": "fault_code", "FaultCode": "fault_code", "Description": "fault_summary",
    "@msg": "fault_summary", "Timestamp": "timestamp", "@t": "timestamp",
    "Severity": "severity", "@sev": "severity", "ToState": "to_state",
    "FromState": "from_state",
}
EVENT_CSV_DISPATCH = ("csv_row", "EventCategory", {
    "ALARM": "fault_event", "FAULT": "fault_event", "ERROR": "fault_event",
    "WARNING": "fault_event", "CRITICAL": "fault_event",
    "EVENT": "generic_operational_observation", "INFO": "generic_operational_observation",
})
WAFER_EVENT_DISPATCH = ("wafer_event", "@sev", {
    "E": "fault_event", "ERROR": "fault_event", "W": "fault_event", "WARN": "fault_event",
    "WARNING": "fault_event", "CRITICAL": "fault_event",
    "I": "generic_operational_observation", "INFO": "generic_operational_observation",
})
DEFAULT_FALLBACKS = [
    ("sensor_reading", "parameter", "sensor_id"),
    ("equipment_state", "curr_state", "event_name"),
]

# --------------------------------------------------------------------------------------
# Prose observations.
# --------------------------------------------------------------------------------------
CHUNK_CHARS = 1800
FINAL_OF_COARSE = {
    "state_change": "equipment_state",
    "process_step_event": "wafer_processing_sequence",
    "measurement_observation": "sensor_reading",
    "fault_or_warning": "fault_event",
    "maintenance_action": "wafer_processing_sequence",
    "logistics_or_disposition": "wafer_processing_sequence",
    "configuration_or_recipe": "process_parameter_recipe",
    "generic_operational_observation": None,
}
OBSERVATION_RENAMES = {
    "wafer_id": "wafer", "lot_id": "lot", "process_step": "step",
    "equipment_id": "equipment", "state": "curr_state", "from_state": "prev_state",
    "to_state": "curr_state", "equipment_state": "curr_state", "event": "event_name",
    "measurement": "parameter", "sensor": "parameter",
}
OBSERVATION_MINIMUMS = {
    "equipment_state": ["curr_state", "prev_state"],
    "process_parameter_recipe": ["recipe", "recipe_id", "recipe_name", "step", "parameter",
                                 "target_value", "duration_s", "temperature_C", "energy",
                                 "dose"],
    "sensor_reading": ["parameter", "value", "unit", "acceptable_range", "target_value",
                       "limit", "threshold"],
    "fault_event": ["fault", "fault_code", "fault_summary", "event_name", "cause", "reason",
                    "component"],
    "wafer_processing_sequence": ["wafer", "lot", "step", "status", "action", "result",
                                  "wafer_count", "wafer_range_start"],
}
MERGE_IDENTITIES = [
    ["wafer", "unit_id", "item_id"],
    ["lot"],
    ["timestamp", "time", "timestamp_hours", "timestamp_approx"],
    ["equipment", "tool", "asset"],
    ["step", "process", "event_name"],
    ["component", "equipment_component", "asset"],
]
CONDENSE_IDENTITIES = [
    ["wafer", "unit_id", "item_id", "wafer_id"],
    ["lot", "lot_id"],
    ["timestamp", "time", "timestamp_hours", "approx_time"],
    ["equipment", "tool", "asset"],
    ["step", "process", "event_name"],
    ["component", "equipment_component", "equipment_part", "asset"],
]
NEVER_ABSORBED = ["summary", "header", "handover"]

# coarse type -> (promoted type, fields of which any one is enough)
PROMOTIONS = {
    "state_change": ("equipment_state",
                     ["new_state", "curr_state", "system_state", "status"]),
    "process_step_event": ("wafer_processing_sequence",
                           ["wafer", "lot", "step", "action", "event_name", "status",
                            "process", "disposition"]),
    "logistics_or_disposition": ("wafer_processing_sequence",
                                 ["wafer", "lot", "step", "action", "event_name", "status",
                                  "process", "disposition"]),
    "maintenance_action": ("wafer_processing_sequence",
                           ["wafer", "lot", "step", "action", "event_name", "status",
                            "process", "disposition"]),
    "measurement_observation": ("sensor_reading",
                                ["parameter", "measurement_name", "value", "measured_value",
                                 "reading_pa", "vacuum_pressure_pa", "thickness_A"]),
    "configuration_or_recipe": ("process_parameter_recipe",
                                ["recipe", "parameter", "target_value", "steps",
                                 "energy_keV", "dose_cm-2", "process"]),
    "fault_or_warning": ("fault_event",
                         ["fault", "issue", "condition", "threshold", "event_name",
                          "associated_issue"]),
}
PROMOTED_STATE_SOURCES = ["new_state", "system_state", "status"]
PROMOTED_VALUE_SOURCES = [("measured_value", None), ("reading_pa", "Pa"),
                          ("vacuum_pressure_pa", "Pa"), ("thickness_A", "A")]

# --------------------------------------------------------------------------------------
# Tagged binary container.
# --------------------------------------------------------------------------------------
TLV_MAGIC = "SLOG"
TLV_TYPES = {
    1: "equipment_state",
    2: "process_parameter_recipe",
    3: "sensor_reading",
    4: "fault_event",
    5: "wafer_processing_sequence",
}
# record type -> (target key, source key) fill-ins, in order
TLV_FILL_INS = {
    "equipment_state": [("curr_state", "state"), ("curr_state", "new_state")],
    "sensor_reading": [("parameter", "metric")],
    "fault_event": [("fault_code", "code"), ("fault_summary", "message")],
    "wafer_processing_sequence": [("event_name", "event")],
}

# --------------------------------------------------------------------------------------
# Dashboard.
# --------------------------------------------------------------------------------------
FACET_FIELDS = ["filename", "tool_id", "lot", "wafer", "step", "severity", "status",
                "parameter", "fault_code"]
DASHBOARD_SEVERE = ["WARN", "ERROR", "CRITICAL", "ALARM"]
DASHBOARD_SAMPLE_ROWS = 50
DASHBOARD_RECENT_FILES = 20
