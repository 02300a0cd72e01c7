"""Declared schemas of the tables that are read from files."""

METADATA = "filename string, label int, label_name string, clsname string, mean array<double>, std array<double>, case string, maskname string"
PROJECT = "orchard string, path string, output_path string, files array<struct<name:string,dimensions:int>>, mask string, reference string, chunk_size double, chunk_overlap double, anomaly_threshold double, scale_ratio double"
RUN = "Epoch int, Train_Loss double, all_case_1_AUROC double, all_case_2_AUROC double"
TILE = "orchard string, i int, j int, case string, split string, height int, width int, channels int, data array<double>"

#: Fixed values of the label tables.
CASES = ("case_1", "case_2", "case_3")
REF_NODATA = -32767.0
INSIDE, OUTSIDE = 0, -999
