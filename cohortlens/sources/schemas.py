"""Input schemas as DDL: the warehouse tables and the CSV extracts, all columns nullable.

Instants are stored in UTC without a zone; ``date_ymd_*`` columns are string
partition columns in ``yyyy-MM-dd`` form and ``hour_kst`` is a zero-padded string.
"""

from __future__ import annotations

TABLES = {
    "recommendation_log": """
        user1_id bigint, user2_id bigint, registered_time timestamp_ntz,
        profile_open_time timestamp_ntz, impression_time timestamp_ntz,
        like_time timestamp_ntz, dislike_time timestamp_ntz,
        friend_request_time timestamp_ntz, other_accepted_time timestamp_ntz,
        joined_time timestamp_ntz, rcmd_type int, channel_id int,
        user1_gender int, user2_gender int, user1_relative_score double,
        exp_props map<string,string>, min_distance double,
        hour_kst string, date_ymd_kst string""",
    "activation_metrics": """
        user_id bigint, gender int, first_approval_time timestamp_ntz,
        last_active_at timestamp_ntz, mobile_hash_user_seq int, ci_hash_user_seq int""",
    "accounts": """
        id bigint, gender int, relative_score double, location string,
        first_approval_time timestamp_ntz, approval_time timestamp_ntz""",
    "screen_log": "user_id bigint, navigations array<string>, date_ymd_kst string",
    "coupon_box": """
        id bigint, created_at timestamp_ntz, received_at timestamp_ntz,
        assigned_user_id bigint, status string, item_id bigint""",
    "coupon_code": """
        id bigint, created_at timestamp_ntz, source_id bigint, used_at timestamp_ntz,
        assigned_user_id bigint, status string, valid_from timestamp_ntz""",
    "coupon_source": "id bigint, coupon_name string, source_channel string",
    "reward_grant": "user_id bigint, source_type string",
    "channel_daily": "channel_id int, rcmd_type int, date_ymd_kst string",
    "type_map": "rcmd_type int, rcmd_type_name string",
    "channel_snapshot": "id int, name string, date_ymd_snapshot string",
    "place_snapshot": "id int, title string, date_ymd_snapshot string",
}

EXTRACTS = {
    "early_exposure": """
        user2_id bigint, min_rc bigint, cumul_rcmd_users bigint,
        cumul_rcmd_response_users bigint, cumul_rcmd_2way_response_users bigint,
        user2_relative_score double""",
    "early_response": "user2_id bigint, min_rr bigint, cumul_rcmd_2way_response_users bigint",
    "usage_log": """
        ci_hash string, get_referral_reward int, relative_score double, user_group string,
        purchase_num double, action_num bigint, quantity double, use_type string,
        description string""",
    "exposure_counts": """
        user_id bigint, relative_score double, rcmd_cnt bigint, del_interval_hour double""",
    "initial_recommendation": """
        user2_relative_score double, min_rc bigint, cumul_rcmd_users double,
        cumul_rcmd_response_users double, cumul_rcmd_users_ini_exc double,
        cumul_rcmd_response_users_ini_exc double""",
    "initial_impression": """
        relative_score double, min_rc bigint, cumul_rcmd_impression_users double,
        cumul_rcmd_impression_users_rcmded double""",
    "initial_response": """
        relative_score double, min_rc bigint, cumul_rcmd_response_users double,
        cumul_rcmd_response_users_rcmded double""",
}
