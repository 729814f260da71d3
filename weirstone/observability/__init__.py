"""Run metrics, reports over them, and detectors of incidents."""
