"""Schemas of the documents that recordings come with, as DDL."""

POINT, BOX = "ARRAY<DOUBLE>", "ARRAY<DOUBLE>"
OBSERVATION = f"time_s DOUBLE, frame_video BIGINT, clip_frame BIGINT, box_2d {BOX}, score DOUBLE, cam_3d {POINT}, world_egoloc {POINT}, world_vggt {POINT}"
DOCUMENTS = {
    "events": "t DOUBLE, text STRING",
    "relations": "schema STRING, clip_uid STRING, source STRING, frame STRING, inverse MAP<STRING,STRING>, params MAP<STRING,DOUBLE>, n_frames_with_pairs BIGINT, n_pair_observations BIGINT, n_episodes BIGINT, episodes ARRAY<STRUCT<a:BIGINT,b:BIGINT,a_name:STRING,b_name:STRING,rel:STRING,t0:DOUBLE,t1:DOUBLE,n_frames:INT,dist_m:DOUBLE>>",
    "questions": "dataset STRING, video_id STRING, clip_uid STRING, approx_duration_s INT, questions ARRAY<STRUCT<qid:STRING,q_id:INT,type:STRING,question:STRING,choices:ARRAY<STRING>,correct_idx:INT,expected_answer:STRING,anchor_t:DOUBLE,object_title:STRING,question_point_3d:ARRAY<DOUBLE>,gt_3d_scan_coords:STRUCT<annotation_1:STRUCT<x:DOUBLE,y:DOUBLE,z:DOUBLE>,annotation_2:STRUCT<x:DOUBLE,y:DOUBLE,z:DOUBLE>>,qwen_reference:STRUCT<answer:STRING,reply:STRING,picked:STRING,predicted_xyz:ARRAY<DOUBLE>,L2_m:DOUBLE,success:BOOLEAN>>>",
    "grid": "clip_uid STRING, video_uid STRING, offset BIGINT, N BIGINT, res ARRAY<INT>, clip_ratio INT, fps DOUBLE, source STRING, grid_clip_frames ARRAY<BIGINT>, titles ARRAY<STRING>, detections ARRAY<STRUCT<tag:STRING,score:DOUBLE,box:ARRAY<DOUBLE>,clip_frame:BIGINT,frame_video:BIGINT,time_s:DOUBLE>>",
    "poses": "clip_uid STRING, good_poses ARRAY<BOOLEAN>, camera_poses ARRAY<ARRAY<ARRAY<DOUBLE>>>, K ARRAY<ARRAY<DOUBLE>>, scale DOUBLE, scale_source STRING, chain_rmse ARRAY<DOUBLE>, chain_reanchored ARRAY<INT>",
    "objects": f"id BIGINT, primary_tag STRING, secondary_tags ARRAY<STRING>, n_members INT, n_obs BIGINT, world_egoloc_median {POINT}, world_vggt_median {POINT}, time_range_s ARRAY<DOUBLE>, name STRING, summary STRING, trajectory ARRAY<STRUCT<{OBSERVATION.replace(' DOUBLE', ':DOUBLE').replace(' BIGINT', ':BIGINT').replace(' ARRAY', ':ARRAY')}>>, segments ARRAY<STRUCT<segment:INT,n_obs:INT,time_range_s:ARRAY<DOUBLE>,rep_frame_video:BIGINT,rep_clip_frame:BIGINT,world:ARRAY<DOUBLE>,box_2d:ARRAY<DOUBLE>,description:STRING>>",
    "qa": "question STRING, options MAP<STRING,STRING>, answer_label STRING, category STRING, subcategory STRING, qid STRING, question_timestamps STRING, video_length STRING, evidence ARRAY<STRUCT<description:STRING,timestamps:STRUCT<start:STRING,end:STRING>>>",
    "annotations": "video_uid STRING, clips ARRAY<STRUCT<clip_uid:STRING,annotations:ARRAY<STRUCT<query_sets:MAP<STRING,STRUCT<object_title:STRING,response_track:ARRAY<STRUCT<frame_number:BIGINT,video_frame_number:BIGINT>>>>>>>>",
    "cuts": "cuts_s ARRAY<DOUBLE>",
}
