"""Declared schemas (DDL) of the files a screening campaign reads and writes."""

from __future__ import annotations

RAW_SCREEN = (
    "sample_id string, structure string, batch_name string, library_id string, "
    "plate_name string, plate_well string, run_date string, inhibition double"
)


MASTER = (
    f"molecule_id long not null, duplicate_id int not null, {RAW_SCREEN}, canonical string, fp string, "
    "activity double, primary_filter double, retest_filter double, alert_filter double"
)
TRAINING = (
    "molecule_id long, sample_id string, library_id string, canonical string, fp string, "
    "inhibition_primary_median double, activity double, primary_filter double, "
    "retest_filter double, alert_filter double"
)
CATALOG_PART = "old_smiles string, smiles string, datestamp string, fingerprints string"
PREDICTIONS = "smiles string, score double"
PROSPECTIVE_SCORES = "old_smiles string, smiles string, id string, score double"
ORDER_RESULTS = (
    "structure_id string, sample_id string, canonical string, fp string, replicate1 double, "
    "replicate2 double, selection string, alert_filter int, hit int, tb_02_id int, "
    "tb_02_leader int, tb_03_id int, tb_03_leader int, tb_04_id int, tb_04_leader int, "
    "qty_mg double, extended_price_usd double"
)
CLUSTERS = (
    "index_id long, dataset string, hit int, fp string, tb_02_id int, tb_02_leader int, "
    "tb_03_id int, tb_03_leader int, tb_04_id int, tb_04_leader int"
)
COSTS = (
    "vendor_id string, smiles string, mw double, price_11_50 double, price_40_49 double, "
    "amount_mg double, status string, delivery_weeks string"
)
DOSE_RESPONSE = (
    "molecule_name string, structure string, control_state string, concentration_um double, "
    "pct_negative_control double"
)
ALERT_RULES = (
    "rule_id int, rule_set_name string, pattern string, max int, description string"
)
