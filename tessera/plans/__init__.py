"""The condition grammar and whole evaluations."""
