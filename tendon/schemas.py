"""Declared schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def ddl(text: str) -> T.StructType:
    return T.StructType.fromDDL(text)


# fixed values: field names and types of the stored tables
TRIAL_SAMPLES = """session_id string, trial_id string, n bigint, timestamp_ms double, emg array<double>, accel array<double>,
 gyro array<double>, direction int, gesture int, stable_mask boolean, session_date string, window_quality double, missing_mask boolean,
 timestamp_valid boolean, imu_valid boolean, interpolated_imu boolean, channel_quality array<double>, quality_gate_pass boolean, metadata_json string"""
REQUIRED = ("session_id", "trial_id", "timestamp_ms", "emg", "accel", "gyro", "direction", "gesture")
CORPUS_SPLIT = "dataset string, start double, end double, split string"
CALIBRATION = """session_id string, emg_center array<double>, emg_scale array<double>, gravity_device array<double>, gyro_bias array<double>,
 device_to_body array<array<double>>, emg_channel_shift int, accel_motion_scale double, gyro_motion_scale double, sample_rate_hz int,
 notch_50hz boolean, calibration_version int, emg_scale_mode string, emg_global_scale double"""
SESSION_TABLES = {
    "meta": """schema_version string, sampling_rate int, emg_nominal_rate_hz int, imu_nominal_rate_hz int, num_emg_channels int, protocol_name string,
 start_datetime string, dataset_split string, quality_report_json string, measured_emg_rate_hz double, measured_imu_rate_hz double, lost_frames int,
 duplicate_frames int, out_of_order_frames int""",
    "emg_samples": "sample_index bigint, packet_seq smallint, pc_received_ns bigint, sample_time_ns bigint, raw array<int>",
    "imu_samples": "packet_seq smallint, pc_monotonic_ns bigint, sample_time_ns bigint, emg_sample_index bigint, accel array<float>, gyro array<float>",
    "trials": """trial_id bigint, stage_id bigint, donning_id bigint, trial_start_sample bigint, rest_start_sample bigint, prompt_start_sample bigint,
 prompt_end_sample bigint, trial_end_sample bigint, label string, reject_reason string, note string, valid boolean, relative_onset_offset_ms int,
 trial_kind string, event_uid string, completion_status string, discard_reason string, block_index int, attempt int, rerecord_of_trial_id bigint,
 stable_start_sample bigint, stable_end_sample bigint, release_prompt_sample bigint""",
    "calibration_blocks": "label string, start_sample bigint, end_sample bigint, valid boolean, attempt int",
    "events": """event_id bigint, sample_index bigint, pc_monotonic_ns bigint, trial_id bigint, stage_id bigint, donning_id bigint, time_sec double,
 event_type string, label string, note string""",
    "cue_events": """name string, sample_index bigint, time_sec double, trial_id bigint, stage_id bigint, scheduled_monotonic_ns bigint,
 emitted_monotonic_ns bigint, event_uid string""",
    "packet_audit": "packet_type smallint, packet_seq smallint, pc_received_ns bigint, lost_before int, duplicate boolean, out_of_order boolean",
}
STATE_LOG = """run_id string, state_sequence bigint, recorded_at_utc string, timestamp_ms bigint, direction string, gesture string, arm_phase string,
 hand_phase string, activation double, motion double, onset_lag_ms double, q_direction double, q_gesture double, emg_quality double, imu_quality double,
 quality_flags bigint, direction_margin double, gesture_margin double, direction_drift double, gesture_drift double"""
